import random

from trellisq.operators import hierarchy as H
from trellisq.session import look_up

LINKS = "parent string, child string"


def labels(spark, links, nodes=None):
    t = H.hierarchy(spark.createDataFrame(links, LINKS), spark.createDataFrame([(n,) for n in nodes], "node string") if nodes else None)
    return {r.node: (r.root, r.depth) for r in t.collect()}, t


def brute(links, nodes=()):
    parent = {}
    names = set(nodes)
    for p, c in links:
        names |= {x for x in (p, c) if x is not None}
        if p is not None and c is not None:
            parent[c] = min(p, parent.get(c, p))
    out = {}
    for n in names:
        seen, x = [], n
        while x in parent and x not in seen:
            seen.append(x)
            x = parent[x]
        out[n] = ("-", -1) if x in seen else (x, len(seen))
    return out


def test_trees_circles_and_odd_rows(spark):
    links = [("a", "b"), ("a", "b"), ("b", "c"), ("b", "d"), ("x", "y"), ("y", "x"), ("x", "z"), ("s", "s"), (None, "n"), ("m", None), ("", "e")]
    got, t = labels(spark, links, ["alone", "a"])
    assert got == brute(links, ["alone", "a"])
    assert got["z"] == ("-", -1) and got["s"] == ("-", -1) and got["e"] == ("", 1) and got["alone"] == ("alone", 0)
    assert {r.node: r.path for r in H.paths(t, "/").collect() if r.path}["c"] == "a/b/c"
    below = H.descendants_of(t, spark.createDataFrame([("a",), ("b",), ("x",)], "node string"))
    assert {(r.ancestor, r.node, r.distance) for r in below.collect()} == {("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)}
    assert {r.node: (r.circle, r.on_circle) for r in H.circles(spark.createDataFrame(links, LINKS)).collect()} == {"x": ("x", True), "y": ("x", True), "z": ("x", False), "s": ("s", True)}


def test_two_parents_take_the_smaller_name(spark):
    assert labels(spark, [("q", "c"), ("p", "c")])[0] == {"c": ("p", 1), "p": ("p", 0), "q": ("q", 0)}


def test_random_forests_with_long_chains_and_wide_nodes(spark):
    rng = random.Random(3)
    names = [f"n{k}" for k in range(150)]
    links = [(names[max(0, k - rng.choice([1, 1, 1, 2, 30]))], names[k]) for k in range(1, 120)]
    links += [("n5", f"w{k}") for k in range(60)] + [(names[k], names[k + 1]) for k in range(130, 148)] + [("n148", "n131")]
    got, t = labels(spark, links)
    want = brute(links)
    assert got == want
    intervals_hold(t, links, want)


def intervals_hold(t, links, want):
    """Places are 0..n-1 in each tree, and the interval of a node holds exactly the nodes that have it above them."""
    rows = {r.node: r for r in H.descendants(t).collect()}
    parent = brute_parents(links)
    above = {n: set() for n in want}
    for n, (root, depth) in want.items():
        x = n
        for _ in range(depth):
            x = parent[x]
            above[n].add(x)
        assert depth >= 0 or (rows[n].place, rows[n].first, rows[n].last) == (None, None, None)
    for root in {r for r, d in want.values() if d >= 0}:
        members = [n for n, (r, _) in want.items() if r == root]
        assert sorted(rows[n].place for n in members) == list(range(len(members)))
        for a in members:
            inside = {n for n in members if rows[a].first is not None and rows[a].first <= rows[n].place <= rows[a].last}
            assert inside == {n for n in members if a in above[n]}


def brute_parents(links):
    parent = {}
    for p, c in links:
        if p is not None and c is not None:
            parent[c] = min(p, parent.get(c, p))
    return parent


def test_skewed_nodes_are_salted(spark, monkeypatch):
    """A star and a long chain, with every join forced past its broadcast."""
    monkeypatch.setattr(H, "look_up", lambda rows, table, on, n=None: look_up(rows, table, on, n, small_rows=3, least_hot=9))
    links = [("hub", f"leaf{k}") for k in range(30)] + [(f"leaf{k}", f"low{k}") for k in range(9)] + [(f"c{k}", f"c{k + 1}") for k in range(5)]
    links += [("c5", "hub"), ("o1", "o2"), ("o2", "o1"), *[("o1", f"t{k}") for k in range(12)]]
    got, t = labels(spark, links)
    want = brute(links)
    assert got == want
    intervals_hold(t, links, want)
    path = {r.node: r.path for r in H.paths(t, "/").collect()}
    assert path["low7"] == "/".join([*[f"c{k}" for k in range(6)], "hub", "leaf7", "low7"]) and path["t3"] is None
    assert sum(r.circle == "o1" and not r.on_circle for r in H.circles(spark.createDataFrame(links, LINKS)).collect()) == 12


def test_large_star_and_long_chain(spark):
    star = spark.range(100_000).selectExpr("'hub' as parent", "concat('s', id) as child")
    chain = spark.range(10_000).selectExpr("concat('c', id) as parent", "concat('c', id + 1) as child")
    t = H.hierarchy(star.unionByName(chain)).groupBy("root").agg({"depth": "max", "place": "max", "*": "count"}).collect()
    assert {r.root: (r["max(depth)"], r["max(place)"], r["count(1)"]) for r in t} == {"hub": (1, 100_000, 100_001), "c0": (10_000, 10_000, 10_001)}


def test_paths_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "CHAIN_BLOCK", 4)
    links = [(f"c{k}", f"c{k + 1}") for k in range(30)] + [("c9", "x"), ("x", "y")]
    path = {r.node: r.path for r in H.paths(labels(spark, links)[1], "/").collect()}
    assert path["c30"] == "/".join(f"c{k}" for k in range(31)) and path["y"] == "/".join([*[f"c{k}" for k in range(10)], "x", "y"])


def test_empty_and_extra_columns(spark):
    assert labels(spark, [])[0] == {}
    df = spark.createDataFrame([("a", "b", "zz", 1)], LINKS + ", node string, size int")
    assert {r.node: r.depth for r in H.hierarchy(df).collect()} == {"a": 0, "b": 1}
