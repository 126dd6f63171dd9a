import random
from collections import Counter
from itertools import combinations

from trellisq.llm.cooccurrence import associations, item_pairs


def frame(spark, baskets):
    return spark.createDataFrame([(b, "x") for b in baskets], "items array<string>, a string")


def test_pairs_equal_brute_force_at_any_block(spark):
    rng = random.Random(2)
    baskets = [[f"t{rng.randrange(40)}" for _ in range(rng.choice([0, 1, 2, 5, 30, 200]))] for _ in range(60)]
    baskets += [None, [], [None, "t1"], ["t1", "t1", None, "t2"], ["t1", "t2"], ["t1", "t2"]]
    want = Counter(p for b in baskets for p in combinations(sorted({x for x in b or [] if x is not None}), 2))
    for block in (1, 3, 7, 128):
        got = {(r.a, r.b): r.n_ab for r in item_pairs(frame(spark, baskets), block).collect()}
        assert got == dict(want)


def test_scores_and_thresholds(spark):
    baskets = [["a", "b"], ["a", "b"], ["a", "c"], [], None, ["c"]]
    r = {(x.a, x.b): x for x in associations(frame(spark, baskets)).collect()}
    ab = r["a", "b"]
    assert (ab.n, ab.n_a, ab.n_b, ab.n_ab, ab.lift) == (6, 3, 2, 2, 2.0)
    assert abs(ab.jaccard - 2 / 3) < 1e-12
    assert {(x.a, x.b) for x in associations(frame(spark, baskets), one_in=3, min_lift=2.0).collect()} == {("a", "b")}
    assert {(x.a, x.b) for x in associations(frame(spark, baskets), one_in=2).collect()} == set()


def test_empty(spark):
    assert associations(frame(spark, [])).collect() == []
    assert associations(frame(spark, [["a", "b"]])).first().npmi == 1.0
