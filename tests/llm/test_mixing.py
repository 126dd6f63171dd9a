import random

from trellisq.llm import mixing

TARGETS = "source string, target_share double, max_repeats int"
SIZED = "doc_id bigint, source string, tokens bigint"


def corpus(rng, sizes):
    return [(i, s, rng.randint(1, 200)) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]


def test_shares_are_met_within_one_document(spark):
    rng = random.Random(4)
    rows = corpus(rng, {"A ": 900, "b": 300, "c": 40, "other": 100}) + [(9000, None, 500), (9001, "b", 0)]
    targets = [("a", 0.3, 1), ("B", 0.5, 9), ("c", 0.2, 2), ("none", 0.1, 3)]
    sized, want = spark.createDataFrame(rows, SIZED), spark.createDataFrame(targets, TARGETS)
    total = sum(r[2] for r in rows)
    report = {r.source: r for r in mixing.mix_report(sized, want).collect()}
    for name, share, repeats in targets:
        r = report[name]
        have = sum(t for _, s, t in rows if s and s.strip().lower() == name.lower())
        assert r.tokens == have and r.reachable == (repeats * have >= share * total)
        if r.reachable:
            assert 0 <= share * total - r.used_tokens <= 200
        else:
            assert r.used_tokens == repeats * have
    copies = mixing.mix(sized, want).collect()
    assert all(r.copies <= {t[0]: t[2] for t in targets}[r.source] for r in copies)
    assert len({r.doc_id for r in copies}) == len(copies)
    again = mixing.mix(sized.repartition(5), want).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, copies))


def test_larger_documents_are_drawn_more_often(spark):
    rows = [(i, "a", 10 if i % 2 else 100) for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, SIZED), spark.createDataFrame([("a", 0.3, 1)], TARGETS)).collect()
    large = sum(r.tokens == 100 for r in got) / 2000
    small = sum(r.tokens == 10 for r in got) / 2000
    assert large > 4 * small > 0


def test_chances_add_up_where_large_documents_are_certain(spark):
    sizes = [1000] * 3 + [10] * 500 + [1] * 700
    rows = [(i, "a", t) for i, t in enumerate(sizes)]
    sized, targets = spark.createDataFrame(rows, SIZED), spark.createDataFrame([("a", 0.6, 1)], TARGETS)
    scale = mixing.inclusion_scale(sized, mixing.source_budgets(sized, targets).withColumnRenamed("tokens", "source_tokens")).first().scale
    assert scale * 1000 > 1 > scale * 10
    assert abs(sum(t * min(1, scale * t) for t in sizes) - 0.6 * sum(sizes)) < 1e-6
    assert sum(r.tokens == 1000 for r in mixing.mix(sized, targets).collect()) == 3


def test_whole_copies_ties_and_repeated_ids(spark):
    rows = [(1, "a", 10), (1, "a", 10), (2, "a", 10), (3, "b", 10)]
    got = mixing.mix(spark.createDataFrame(rows, SIZED), spark.createDataFrame([("a", 1.5, 2)], TARGETS)).collect()
    assert sum(r.tokens * r.copies for r in got) == 60 and all(r.copies == 2 for r in got)


def test_empty_tables(spark):
    none, t = spark.createDataFrame([], SIZED), spark.createDataFrame([("a", 0.5, 1)], TARGETS)
    assert mixing.mix(none, t).collect() == []
    r = mixing.mix_report(none, t).first()
    assert (r.tokens, r.used_tokens, r.reachable) == (0, 0, True)
    docs = spark.createDataFrame([(1, "s", "x")], SIZED.replace("tokens bigint", "text string"))
    assert mixing.mix(mixing.with_tokens(docs, ["doc_id", "source"], "text", mixing.DEFAULT_TOKENIZER), spark.createDataFrame([], TARGETS)).collect() == []


def test_token_counts_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "a b" * 5000, "k"), (4, "<|endoftext|>", "k")], "doc_id int, text string, source string")
    got = {r.doc_id: r.tokens for r in mixing.with_tokens(docs, ["doc_id"], "text", mixing.DEFAULT_TOKENIZER).collect()}
    assert got[1] == got[2] == 0 and got[3] >= 5000 and got[4] > 1
