import random

import numpy as np

from trellisq.llm import contamination as C

DIR = "/root/testdata/sf0.01"
NOUNS = "anvil kettle spindle lantern pebble feather saddle hammer gourd trumpet ribbon crate".split()
ADJ = "rusty velvet amber hollow twin brittle silver frosted".split()
ROLES = "mason cooper potter weaver tinker keeper miller".split()
FRAMES = [
    "Help the {r} choose {n} {a} {o}s such that their combined weight equals {m}.",
    "After every {n} {o}s spent, the {r} must polish the {a} {p} once more.",
    "Nobody wants to move more than {n} {a} {o}s before noon, least of all the {r}.",
    "The {a} tower keeps {m} {o}s, and the {p} numbered {n} is always sealed.",
    "If no {o} is {a}, the barn closes and {m} {p}s are lost to the {r}.",
    "It is guaranteed that the answer exists.",
]
FILLER = "we sort the list and then update the answer while the other part follows from symmetry in the worst case".split()
P = C.Leaks(hash_bits=11, rank=24)


def item(rng):
    fs = rng.sample(FRAMES, 4)
    return " ".join(f.format(r=rng.choice(ROLES), n=rng.randint(2, 99), a=rng.choice(ADJ), o=rng.choice(NOUNS), p=rng.choice(NOUNS), m=rng.randint(100, 999)) for f in fs)


def filler(rng, n):
    return " ".join(rng.choice(FILLER) for _ in range(n))


def test_leaks_found_and_siblings_left(spark):
    rng = random.Random(9)
    items = [(k, item(rng)) for k in range(40)]
    docs, want = [], set()
    for d in range(300):
        kind = d % 4
        k, t = rng.choice(items)
        w = t.split()
        if kind == 0:  # whole or in part, with small changes and other dress
            n = rng.randint(len(w) * 6 // 10, len(w))
            s = rng.randint(0, len(w) - n)
            part = [x if rng.random() > 0.06 else "other" for x in w[s:s + n]]
            body = rng.choice([str.lower, str.upper, lambda x: f"<p>{x}</p>", lambda x: x.replace(".", "")])(" ".join(part))
            want.add((d, k))
        elif kind == 1:
            body = item(rng)  # same frames, other fillers
        elif kind == 2:
            body = " ".join(w[: len(w) // 5])  # short quote
        else:
            body = "It is guaranteed that the answer exists."
        docs.append((d, f"{filler(rng, 40)}\n{body}\n{filler(rng, rng.randint(5, 300))}", "x"))
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string").repartition(3)
    it = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in C.find_leaks(df, it, P).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)
    blocks = C.find_leaks(df, it, C.Leaks(hash_bits=11, rank=24, items_per_block=15)).collect()
    assert {(r.doc_id, r.item_id) for r in blocks} == got


def test_every_third_word_replaced_is_found(spark):
    rng = random.Random(2)
    vocabulary = [a + b for a in ("bra", "cle", "dor", "fim", "gul") for b in ("nt", "sk", "mel", "vo", "ram", "tis")]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(60))) for k in range(30)]
    docs = []
    for k, t in items:
        w = t.split()
        w[2::3] = [f"other{k}x{n}" for n in range(20)]
        docs.append((k, f"{filler(rng, 30)} {' '.join(w)} {filler(rng, 30)}"))
    got = C.find_leaks(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"), C.Leaks(hash_bits=11, rank=24))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(k, k) for k in range(30)}


def test_planted_passages_against_an_exact_search(spark):
    rng = random.Random(4)
    texts = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").orderBy("item_id").collect()]
    around = [C.words_of(r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").where("length(text) > 200").orderBy("doc_id").collect()]
    around = [w for w in around if len(w) >= 30]
    words = [C.words_of(t) for t in texts]
    codes = [C.coded(w, {}) for w in words]
    p = C.Leaks()
    coded = C.with_words(spark.createDataFrame(list(enumerate(texts)), "item_id int, text string"), "item_id")
    frames = C.item_frames(coded, len(texts), p.frame_share)
    distinct = [C.distinct_words(c, frames) for c in codes]
    docs, want = [], {0.0: set(), 0.15: set()}
    for d in range(320):
        share, change = (0.4, 0.45, 0.5, 0.6)[d % 4], (0.0, 0.15)[d // 4 % 2]
        k, host = rng.randrange(len(texts)), rng.choice(around)
        n = -(-len(words[k]) * round(share * 100) // 100)
        s, at = rng.randint(0, len(words[k]) - n), rng.randint(0, len(host))
        part = [x if rng.random() >= change else rng.choice(host) for x in words[k][s:s + n]]
        docs.append((d, " ".join(host[:at] + part + host[at:])))
        doc = C.coded(host[:at] + part + host[at:], {}).astype("int64")
        if C.held_shares([(codes[k].astype("int64"), distinct[k], doc)], p)[0] >= 0.4:
            want[change].add((d, k))
    items = spark.createDataFrame(list(enumerate(texts)), "item_id int, text string")
    got = {(r.doc_id, r.item_id) for r in C.find_leaks(spark.createDataFrame(docs, "doc_id int, text string"), items).collect()}
    assert len(want[0.0]) > 120 and want[0.0] <= got
    assert len(want[0.15] & got) >= 0.99 * len(want[0.15])


def test_basis_equals_a_plain_svd(spark):
    rng = random.Random(1)
    p = C.Leaks(hash_bits=8, rank=4, oversample=12)
    docs = spark.createDataFrame([(k, " ".join(f"t{k % 4}w{rng.randrange(12)}" for _ in range(32))) for k in range(120)], "doc_id int, text string")
    words = C.with_words(docs, "doc_id").cache()
    df, n = C.document_frequencies(words, p)
    assert n == 120
    idf = np.log((1 + n) / (1 + df)).astype(np.float32)
    a = np.zeros((120, 256))
    for k, r in enumerate(words.collect()):
        row, term, count = C._sparse(np.array(r.words), np.zeros(32, dtype=np.int64), 8)
        a[k, term] = C._weights(row, term, count, idf)[0]
    vt = np.linalg.svd(a, full_matrices=False)[2][:4]
    basis = C.latent_basis(words, idf, p)
    cosines = np.linalg.svd(vt @ basis)[1]
    assert cosines.min() > 0.98


def test_odd_rows(spark):
    t = item(random.Random(3))
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "!!!"), (4, t), (4, t), (5, "word " * 100_000 + t)], "doc_id int, text string")
    items = spark.createDataFrame([(1, t), (1, t), (2, None), (3, "")], "item_id int, text string")
    got = sorted((r.doc_id, r.item_id) for r in C.find_leaks(docs, items, P).collect())
    assert got == [(4, 1), (4, 1), (5, 1)]
    none = spark.createDataFrame([], "doc_id int, text string")
    assert C.find_leaks(none, items, P).collect() == [] and C.find_leaks(docs, items.limit(0), P).collect() == []


def test_sums_do_not_depend_on_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(C, "_FAN_IN", 2)
    p = C.Leaks(hash_bits=8, rank=4, oversample=4)
    rng = random.Random(5)
    words = C.with_words(spark.createDataFrame([(k, filler(rng, 20)) for k in range(60)], "doc_id int, text string"), "doc_id")
    idf, omega = np.ones(256, np.float32), np.random.default_rng(0).standard_normal((256, 8)).astype(np.float32)
    one, many = (C._sketch(words.repartition(n), idf, omega, p) for n in (1, 7))
    assert np.allclose(one[0], many[0], rtol=1e-4) and np.allclose(one[1], many[1], atol=1e-3)


def test_alignment_equals_a_plain_subsequence(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 5, (200, 10)), rng.integers(0, 5, (200, 25))
    met = C._aligned(a, b)

    def length(x, y):
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, u in enumerate(x):
            for j, v in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if u == v else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    assert met.sum(axis=1).tolist() == [length(x, y) for x, y in zip(a.tolist(), b.tolist())]
