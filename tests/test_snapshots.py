import random

from pyspark.sql import functions as F

from trellisq.operators.snapshots import discard_report, snapshot_changes

SCHEMA = "snap int, k1 int, k2 string, loaded int, v int, tags array<string>"


def run(spark, rows, schema=SCHEMA, **kw):
    df = spark.createDataFrame(rows, schema)
    out = snapshot_changes(df, "snap", ["k1", "k2"], "loaded", {"v": F.col("v"), "t": F.array_sort("tags")}, **kw)
    return sorted(((r.snapshot_id, r.k1, r.k2, r.change) for r in out.collect()), key=str)


def brute(rows):
    held = {}
    for s, a, b, loaded, v, t in rows:
        key = (s, a, b)
        state = (loaded, v, tuple(sorted(t or [])))
        if key not in held or state > held[key]:
            held[key] = state
    snaps = sorted({r[0] for r in rows})
    out = []
    for s, n in zip(snaps, snaps[1:]):
        old = {k[1:]: x[1:] for k, x in held.items() if k[0] == s}
        new = {k[1:]: x[1:] for k, x in held.items() if k[0] == n}
        for k in old.keys() | new.keys():
            c = "added" if k not in old else "removed" if k not in new else "changed" if old[k] != new[k] else None
            if c:
                out.append((n, *k, c))
    return sorted(out, key=str)


def test_random_snapshots_with_repeats(spark):
    rng = random.Random(5)
    rows = []
    for s in (1, 2, 4):
        for a in range(60):
            for b in "ABC":
                if rng.random() < 0.9:
                    rows.append((s, a, b, 1, a % 7 if rng.random() < 0.95 else 99, ["x", "y"]))
                    if rng.random() < 0.1:
                        rows.append(rows[-1])
                    if rng.random() < 0.1:
                        rows.append((s, a, b, 2, 50, ["z"]))
    for chunk in (1, 8, 1000):
        assert run(spark, rows, mean_chunk_rows=chunk) == brute(rows)


def test_null_values_keys_and_order_of_tags(spark):
    rows = [(1, 1, "A", 1, None, ["x", "y"]), (2, 1, "A", 1, 0, ["y", "x"]), (1, 2, "A", 1, 3, ["x", "y"]), (2, 2, "A", 1, 3, ["y", "x"]),
            (1, None, None, 1, 1, None), (2, None, None, 1, 2, None), (None, 9, "A", 1, 1, None)]
    assert run(spark, rows) == [(2, 1, "A", "changed"), (2, None, None, "changed")]


def test_empty_single_and_extra_columns(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, 1, "A", 1, 1, [])]) == []
    rows = [(1, 1, "A", 1, 1, [], "c"), (2, 1, "B", 1, 1, [], "d")]
    assert run(spark, rows, SCHEMA + ", chunk string") == [(2, 1, "A", "removed"), (2, 1, "B", "added")]


def test_most_rows_are_discarded_by_their_digests(spark):
    rng = random.Random(6)
    rows = [(s, a, "A", 1, a if s == 1 or rng.random() > 0.01 else -1, ["x"]) for s in (1, 2) for a in range(5000)]
    df = spark.createDataFrame(rows, SCHEMA)
    r = discard_report(df, "snap", ["k1", "k2"], "loaded", {"v": F.col("v"), "t": F.col("tags")}).first()
    assert r.n_rows == 10_000 and r.discarded_share > 0.9
    assert run(spark, rows) == brute(rows)
    none = discard_report(df.limit(0), "snap", ["k1", "k2"], "loaded", {"v": F.col("v")}).first()
    assert tuple(none) == (0, 0, None)
