"""Literal cases of the practice rules."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trellisq.functions import ladders as L
from trellisq.operators import contests as C
from trellisq.operators import knowledge as K
from trellisq.operators import markup as M
from trellisq.operators import progress as G
from trellisq.operators import recommend as R
from trellisq.sources import domain as D
from trellisq.operators import topics as T
from trellisq.sources import api
from trellisq.sources.domain import target_rating
from trellisq.streaming.jobs import session_phase


def one(spark, col, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(col).first()[0]


def greedy(rows, count, half):
    """rows: (group, url) in the order of their scores."""
    taken, rest, used, urls = [], [], {}, set()
    for k, (g, u) in enumerate(rows):
        if used.get(g, 0) < 2 or (half and len(taken) < max(1, count // 2)):
            taken.append(k)
            used[g] = used.get(g, 0) + 1
            urls.add(u)
        else:
            rest.append(k)
        if len(taken) == count:
            return taken
    for k in rest:
        if len(taken) == count:
            break
        if rows[k][1] not in urls:
            taken.append(k)
            urls.add(rows[k][1])
    return taken


@pytest.mark.parametrize("half", [True, False])
def test_diversity_equals_greedy(spark, half):
    rng = random.Random(11)
    cases = []
    for user in range(120):
        n, groups = rng.randint(0, 30), rng.randint(1, 6)
        cases.append([(f"g{rng.randrange(groups)}", f"u{user}-{k}") for k in range(n)])
    rows = [(u, k, g, url, 1000.0 - k) for u, c in enumerate(cases) for k, (g, url) in enumerate(c)]
    df = spark.createDataFrame(rows, "user_id int, k int, g string, url string, score double").repartition(7)
    for count in (1, 4, 8):
        got = {}
        for r in R.diversified(df, count, "g", [F.desc("score")], half, "url").orderBy("user_id", "pos").collect():
            got.setdefault(r.user_id, []).append(r.k)
        for u, c in enumerate(cases):
            assert got.get(u, []) == greedy(c, count, half)


def test_diversity_fills_up_with_unseen_urls(spark):
    rows = [(1, k, "g", f"u{k // 2}", 10.0 - k) for k in range(8)]
    df = spark.createDataFrame(rows, "user_id int, k int, g string, url string, score double")
    got = [r.k for r in R.diversified(df, 8, "g", [F.desc("score")], True, "url").orderBy("pos").collect()]
    assert got == greedy([("g", f"u{k // 2}") for k in range(8)], 8, True)


@pytest.mark.parametrize("half", [True, False])
def test_diversity_with_many_repeated_urls_equals_greedy(spark, half):
    rng = random.Random(12)
    cases = [[(f"g{rng.randrange(rng.choice([1, 3]))}", f"u{rng.randrange(rng.choice([1, 2, 15]))}") for _ in range(rng.randint(0, 60))] for _ in range(80)]
    cases.append([("g", "same")] * 8 + [("g", f"own{k}") for k in range(12)])
    rows = [(u, k, g, url, 1000.0 - k) for u, c in enumerate(cases) for k, (g, url) in enumerate(c)]
    df = spark.createDataFrame(rows, "user_id int, k int, g string, url string, score double").repartition(5)
    for count in (2, 8):
        got = {}
        for r in R.diversified(df, count, "g", [F.desc("score")], half, "url").orderBy("user_id", "pos").collect():
            got.setdefault(r.user_id, []).append(r.k)
        for u, c in enumerate(cases):
            assert got.get(u, []) == greedy(c, count, half)


def test_recommendation_does_not_depend_on_the_blocks(spark):
    d = "/root/testdata/sf0.001"
    users, subs = D.users(spark, d), D.submissions(spark, d)
    # Few urls, so that they repeat inside and across blocks.
    problems = D.problems(spark, d).withColumn("url", F.concat(F.lit("u"), F.pmod(F.col("catalog_pos"), F.lit(13)).cast("string")))
    for mode in ("balanced", "explore", "grind"):
        whole, parts = (
            sorted(map(tuple, R.recommend(users, subs, problems, mode, block_rows=n).collect())) for n in (1_000_000, 40))
        assert whole == parts and whole


def test_quotas():
    assert [R.quotas(n, True) for n in (0, 1, 4, 8)] == [(0, 0), (1, 0), (3, 1), (6, 2)]
    assert R.quotas(8, False) == (8, 0)


def test_interleave_continues_with_the_longer_side(spark):
    s = "user_id int, pos int, platform string, item_id string, score double"
    a = spark.createDataFrame([(1, k, "a", f"a{k}", 1.0) for k in (1, 2, 3)], s)
    b = spark.createDataFrame([(1, 1, "b", "b1", 1.0)], s)
    assert [r.item_id for r in R.interleaved(a, b, 4).orderBy("pos").collect()] == ["a1", "b1", "a2", "a3"]


def test_target_of_unrated_users(spark):
    assert [one(spark, target_rating(F.col("r").cast("int")), r=r) for r in (None, 0, 1)] == [800, 800, 1]


def test_topic_rules(spark):
    subs = spark.createDataFrame(
        [(1, 1, "A", True), (1, 1, "A", False), (1, 1, "B", True), (1, 1, "C", True), (1, 9, "Z", True)],
        "user_id int, contest_id int, idx string, ok boolean")
    problems = spark.createDataFrame(
        [(1, "A", 1000, ["x", "2-sat"]), (1, "B", None, ["x"]), (1, "C", 1400, ["y", "y"])],
        "contest_id int, idx string, rating int, tags array<string>")
    got = {r.tag: (r.attempted, r.solved, r.avg_rating) for r in T.topic_stats(subs, problems).collect()}
    assert got == {"x": (2, 1, 1000.0), "y": (2, 2, 1400.0)}
    assert [r.tag for r in T.weak_tags(T.topic_stats(subs, problems)).collect()] == ["x"]


def days(spark, offsets, ok=True):
    base = dt.datetime(2025, 3, 10, 12)
    rows = [(1, base + dt.timedelta(days=o, minutes=k), ok) for k, o in enumerate(offsets)]
    d = spark.createDataFrame(rows, "user_id int, at timestamp, ok boolean")
    r = G.streaks(d, F.lit("2025-03-10").cast("date")).collect()
    return (r[0].submission_streak, r[0].solve_streak) if r else None


@pytest.mark.parametrize("offsets,n", [([0, -1, -2], 3), ([-1, -2], 2), ([-2, -3], 0), ([0, -2], 1), ([0, 0, -1], 2)])
def test_streaks(spark, offsets, n):
    assert days(spark, offsets) == (n, n)
    assert days(spark, offsets, False) == (n, 0)


def test_no_submissions_no_streak(spark):
    assert days(spark, []) is None


def test_slot_targets():
    assert C.slot_targets(2, 3) == [800, 1100, 1400]
    assert C.slot_targets(2, 12)[-1] == 3500 and C.slot_targets(2, 6)[-1] == 2300
    assert C.slot_targets(4, 9)[-2:] == [1500, 1600] and C.slot_targets(9, 5) == C.slot_targets(2, 5)
    assert [C.clamped_count(n) for n in (0, 3, 7, 12)] == [3, 3, 7, 10]


def test_virtual_contest_skips_and_widens(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id int")
    problems = spark.createDataFrame(
        [(1, "A", 800), (1, "B", 820), (1, "C", 1450), (1, "D", None), (2, "A", 2500)], "contest_id int, idx string, rating int")
    subs = spark.createDataFrame([(2, 1, "A", True), (2, 1, "B", False)], "user_id int, contest_id int, idx string, ok boolean")
    got = sorted((r.user_id, r.letter, r.contest_id, r.idx) for r in C.virtual_contest(users, subs, problems, least_pool=1).collect())
    assert got == [(1, "A", 1, "A"), (1, "B", 1, "B"), (1, "C", 1, "C"), (1, "D", 2, "A"), (2, "A", 1, "B"), (2, "B", 1, "C"), (2, "C", 2, "A")]


def test_virtual_contest_draws_from_the_free_ones(spark):
    users = spark.range(60).selectExpr("cast(id as int) as user_id")
    problems = spark.createDataFrame([(1, f"P{k:02d}", 800 + 10 * k) for k in range(12)], "contest_id int, idx string, rating int")
    subs = spark.createDataFrame([(u, 1, f"P{k:02d}", True) for u in range(60) for k in range(u % 5)], "user_id int, contest_id int, idx string, ok boolean")
    rows = C.virtual_contest(users, subs, problems, count=2).collect()
    assert rows == C.virtual_contest(users, subs, problems, count=2).collect() and len(rows) == 120
    picked = {(r.user_id, r.idx) for r in rows}
    assert len(picked) == 120 and not any(int(i[1:]) < u % 5 for u, i in picked)
    assert len({i for _, i in picked}) > 8


def test_contest_classes(spark):
    names = ["Round 1 (Div. 1 + Div. 2)", "x div. 1", "Educational Round (Div. 2)", "Div. 4", "Educational Round", "Global Round", "Cup", None]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, name string")
    got = [r[0] for r in df.orderBy("k").select(L.contest_class(F.col("name"))).collect()]
    assert got == ["Combined", "Div. 1", "Div. 2", "Div. 4", "Educational", "Global Round", "Other", "Other"]


def test_natural_order(spark):
    df = spark.createDataFrame([(x,) for x in ["B1", "Ex", "A", "10", "2", "A2"]], "idx string")
    assert [r.idx for r in df.orderBy(L.natural_key(F.col("idx")), "idx").collect()] == ["2", "A", "B1", "A2", "10", "Ex"]


def test_ladders_and_clock(spark):
    rows = spark.createDataFrame([(r,) for r in (None, 0, 1199, 2299, 2300, 2450, 2600)], "r int").select(
        L.heat_class(F.col("r")), L.list_class(F.col("r")), L.practice_class(F.col("r"))).collect()
    assert [tuple(x) for x in rows] == [
        ("newbie", "", "newbie"), ("newbie", "", "newbie"), ("newbie", "newbie", "newbie"), ("master", "master", "master"),
        ("gm", "gm", "im"), ("gm", "gm", "gm"), ("gm", "lgm", "lgm")]
    assert one(spark, L.clock(F.col("s")), s=3661) == "01:01:01"
    assert one(spark, L.clock(F.col("s")), s=360000) == "100:00:00"


def test_solved_states_of_a_page(spark):
    li = '<li class="task">'
    html = (f'<ul>{li}<a href="/task/1">a</a><span class="task-score icon full"></span></li>{li}<a href="/task/2">b</a>'
            f'<span class="task-score icon"></span></li>{li}<a href="/task/3">c</a><span class="task-score fullness"></span></li>'
            f'{li}x <a href="/task/4">d</a></li>')
    pages = spark.createDataFrame([(1, html), (2, ""), (3, None)], "page_id int, html string")
    assert sorted((r.task_id, r.solved) for r in M.items(pages).collect()) == [(1, True), (2, False), (3, False)]


def test_freshness(spark):
    now = F.lit("2025-01-01 12:00:00").cast("timestamp_ntz")
    cases = {"2025-01-01T06:00:01Z": True, "2025-01-01T05:59:59Z": False, None: True, "garbage": True}
    for v, want in cases.items():
        assert one(spark, M.fresh(F.col("v").cast("string"), now), v=v) is want


def test_tolerant_json(spark):
    f = K.tolerant_json(F.col("v"))
    assert one(spark, f, v='<think>{"a": 1}\n</think>```json\n{"k": 2}\n```') == '{"k": 2}'
    assert one(spark, f, v='noise {"k": "a\\q"} tail') == '{"k": "a\\\\q"}'
    assert one(spark, f, v="none") is None


def test_search(spark):
    lists = "variants pitfalls prereqs leads_to cpp_notes tags".split()
    texts = "title category description explanation key_insight worked_example when_to_use walkthrough proof slug".split()
    schema = "entry_id int, " + ", ".join([f"{x} array<string>" for x in lists] + [f"{x} string" for x in texts])
    row = (1, ["one two", "three"], None, None, None, None, ["Zeta"], *(["-"] * 9), "s")
    df = spark.createDataFrame([row], schema)
    found = lambda q: [r.match_in for r in K.search(df, q).collect()]
    assert found("TWO three") == ["variants"] and found(" zeta ") == ["tags"] and found("  ") == [] and found("none") == []
    assert one(spark, K.highlighted(F.col("t"), "b&"), t="a<B&c") == "a&lt;<mark>B&amp;</mark>c"


def test_generation_falls_back_to_the_sentinel(spark):
    df = spark.createDataFrame([("a", "fine"), ("b", "bad")], "slug string, prompt string")

    def model(p):
        if p == "bad":
            raise ValueError
        return p.upper()

    got = {r.slug: (r.description, r.failed) for r in K.generate(df, model).collect()}
    assert got == {"a": ("FINE", False), "b": (K.SENTINEL, True)}


def test_api_retries():
    calls = []

    def limited(url):
        calls.append(url)
        return '{"status": "OK", "result": [1]}' if len(calls) == 3 else '{"status": "FAILED", "comment": "Call limit exceeded"}'

    assert api.fetch("u", limited, wait=0) == [1] and len(calls) == 3
    calls.clear()

    def refused(url):
        calls.append(url)
        return '{"status": "FAILED", "comment": "no such handle"}'

    with pytest.raises(api.ApiError):
        api.fetch("u", refused, wait=0)
    assert len(calls) == 1

    def down(url):
        raise OSError("down")

    with pytest.raises(OSError):
        api.fetch("u", down, wait=0)


def test_session_phases(spark):
    t = dt.datetime(2025, 1, 1)
    f = session_phase(F.col("a").cast("timestamp"), F.col("b").cast("timestamp"), 3600)
    at = lambda m: one(spark, f, a=t, b=t + dt.timedelta(minutes=m))
    assert [at(m) for m in (0, 56, 59.5, 60)] == ["running", "warning", "critical", "expired"]
    assert one(spark, session_phase(F.lit(None).cast("timestamp"), F.current_timestamp(), 60)) == "idle"
