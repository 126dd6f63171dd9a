"""Evaluation passages that turn up, whole or in part, in a corpus.

Method: latent semantic retrieval. Texts become word codes once. Passages of
all documents become TF-IDF vectors over hashed words; a distributed randomised
SVD gives a latent space. Items are stored in blocks in the shared folder with
the latent vectors of their windows; a task probes the cells of a block that
are nearest to a document's window, and documents with a window like one of an
item are candidates for it. Candidates are aligned with the item by longest
common subsequences of short windows; the words that tell the item from its
siblings (fillers and numbers, the answer check) have to agree.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellisq.session import cut_lineage, read_block, stored_blocks


@dataclass(frozen=True)
class Leaks:
    """Parameters of the search.

    ``probes`` cells of a block are searched for each window of a document, of
    as many cells as the square root of its windows; what the cells and the
    cosine lose is measured in the tests.
    """

    hash_bits: int = 14
    rank: int = 64
    oversample: int = 16
    fit_words: int = 64
    least_window: int = 4
    steps: int = 4
    cosine: float = 0.5
    probes: int = 8
    items_per_block: int = 5000
    window: int = 10
    window_matches: int = 7
    min_share: float = 0.4
    frame_share: float = 0.02
    seed: int = 11


# Markup that is no part of the words.
_MARKUP = re.compile(r"</?[a-zA-Z][^<>]{0,60}>|&[a-z]+;|[*_`$]")
_WORD = re.compile(r"\w+")
#: Words that a task turns into numbers at once.
_PIECE = 1 << 18


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(_MARKUP.sub(" ", text.lower())) if text else []


def coded(words: list[str], known: dict[str, int]) -> np.ndarray:
    """31-bit codes of words, odd for numbers; ``known`` remembers them."""
    out = []
    for w in words:
        c = known.get(w)
        if c is None:
            if len(known) > 500_000:
                known.clear()
            c = known[w] = (zlib.crc32(w.encode()) >> 1 & ~1) | w.isdigit()
        out.append(c)
    return np.array(out, dtype=np.int32)


def with_words(texts: DataFrame, key: str) -> DataFrame:
    """(key, words): the word codes of each text, in order; null and wordless texts have none."""
    rows = texts.select(key, "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            codes = [coded(words_of(t), known) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0] + [len(c) for c in codes]).astype(np.int32)
            flat = np.concatenate(codes) if codes else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, flat)], [key, "words"])

    return rows.mapInArrow(read, f"{key} {rows.schema[key].dataType.simpleString()}, words array<int>")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column, offsets from 0."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    return values, offsets - offsets[0]


def _passages(values: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces (word codes, passage of each word): texts are cut into disjoint passages of ``size`` words."""
    starts = np.concatenate([np.arange(a, b, size) for a, b in zip(offsets[:-1], offsets[1:])] or [np.empty(0, np.int64)])
    per = max(1, _PIECE // size)
    for k in range(0, len(starts), per):
        first = starts[k]
        last = starts[k + per] if k + per < len(starts) else len(values)
        passage = np.zeros(last - first, dtype=np.int64)
        passage[starts[k + 1:k + per] - first] = 1
        yield values[first:last], np.cumsum(passage)


def _terms(codes: np.ndarray, bits: int) -> np.ndarray:
    return (codes.astype(np.int64) >> 1) & ((1 << bits) - 1)


def _sparse(codes: np.ndarray, passage: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, term, count) of the distinct terms of passages, by passage and term."""
    key, count = np.unique(passage << bits | _terms(codes, bits), return_counts=True)
    return key >> bits, key & ((1 << bits) - 1), count


def _weights(passage: np.ndarray, term: np.ndarray, count: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L2-normalised TF-IDF weights, and where each passage begins."""
    v = ((1 + np.log(count)) * idf[term]).astype(np.float32)
    begins = np.flatnonzero(np.diff(passage, prepend=-1))
    norms = np.maximum(np.sqrt(np.add.reduceat(v * v, begins)), 1e-9)
    return v / norms[passage], begins


def document_frequencies(words: DataFrame, p: Leaks) -> tuple[np.ndarray, int]:
    """Of each hashed word the number of passages of all documents that hold it, and the number of passages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << p.hash_bits, dtype=np.int64), 0
        for b in batches:
            for codes, passage in _passages(*_lists(b.column(0)), p.fit_words):
                df += np.bincount(_sparse(codes, passage, p.hash_bits)[1], minlength=len(df))
                n += int(passage[-1]) + 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["term", "n"])

    # At most 2^hash_bits + 1 rows reach the driver.
    found = words.select("words").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << p.hash_bits)
    total = int(found.loc[found["term"] < 0, "n"].sum()) if len(found) else 0
    kept = found[found["term"] >= 0]
    df[kept["term"].to_numpy(dtype=np.int64)] = kept["n"].to_numpy()
    return df, total


#: Partial sums that one task adds up.
_FAN_IN = 64


def _sketch(words: DataFrame, idf: np.ndarray, omega: np.ndarray, p: Leaks) -> tuple[np.ndarray, np.ndarray]:
    """G = Y'Y and C = Y'A for Y = A omega, A being the passages of all documents, in one pass.

    Partial sums are added up in levels of _FAN_IN, so a task adds that many
    vectors at most, however many partitions there are.
    """
    sc = words.sparkSession.sparkContext
    shared = sc.broadcast((idf, omega))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own_idf, own_omega = shared.value
        width = own_omega.shape[1]
        g = np.zeros((width, width))
        c = np.zeros((own_omega.shape[0], width), dtype=np.float32)
        for b in batches:
            for codes, passage in _passages(*_lists(b.column(0)), p.fit_words):
                row, term, count = _sparse(codes, passage, p.hash_bits)
                v, begins = _weights(row, term, count, own_idf)
                y = np.add.reduceat(v[:, None] * own_omega[term], begins, axis=0)
                g += y.T.astype(np.float64) @ y
                by_term = np.argsort(term, kind="stable")
                sorted_terms = term[by_term]
                first = np.flatnonzero(np.diff(sorted_terms, prepend=-1))
                c[sorted_terms[first]] += np.add.reduceat(v[by_term, None] * y[row[by_term]], first, axis=0)
        flat = np.concatenate((g.astype(np.float32), c.T), axis=1)
        ends = np.arange(width + 1, dtype=np.int32) * flat.shape[1]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(width)), pa.array(np.full(width, TaskContext.get().partitionId())),
            pa.ListArray.from_arrays(ends, flat.ravel())], ["row", "part", "values"])

    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack([np.asarray(v) for v in pdf["values"]]), axis=0, dtype=np.float64)
        return pd.DataFrame({"row": [pdf["row"].iloc[0]], "part": [pdf["part"].iloc[0]], "values": [total.tolist()]})

    schema = "row bigint, part bigint, values array<float>"
    parts = words.rdd.getNumPartitions()
    sums = words.select("words").mapInArrow(partial, schema)
    while True:
        sums = sums.withColumn("part", F.floor(F.col("part") / _FAN_IN)).groupBy("row", "part").applyInPandas(add, schema)
        parts = -(-parts // _FAN_IN)
        if parts <= 1:
            break
    rows = sums.toPandas()
    width = omega.shape[1]
    g, c = np.zeros((width, width)), np.zeros((width, omega.shape[0]))
    for r, values in zip(rows["row"], rows["values"]):
        g[r], c[r] = values[:width], values[width:]
    shared.unpersist()
    return g, c


def latent_basis(words: DataFrame, idf: np.ndarray, p: Leaks) -> np.ndarray:
    """Right singular vectors (terms x rank) of the passages, by randomised SVD with one power step.

    With Y = A omega = QR, Q'A is R^-T Y'A; both products come from one pass.
    """
    rng = np.random.default_rng(p.seed)
    omega = rng.standard_normal((1 << p.hash_bits, p.rank + p.oversample)).astype(np.float32)
    for _ in range(2):
        g, c = _sketch(words, idf, omega, p)
        w, u = np.linalg.eigh(g + np.eye(len(g)) * 1e-9 * max(np.trace(g), 1e-9))
        b = (u / np.sqrt(np.maximum(w, 1e-12))).T @ c
        _, _, vt = np.linalg.svd(b, full_matrices=False)
        omega = np.ascontiguousarray(vt.T).astype(np.float32)
    return omega[:, : p.rank]


def _window_words(n: int, p: Leaks) -> int:
    """The window for items of n words: the largest power of two within the shortest passage that counts."""
    shortest = max(math.ceil(p.min_share * n), p.least_window)
    return 1 << (shortest.bit_length() - 1)


def _windows(offsets: np.ndarray, size: int, p: Leaks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the windows that cover texts; the last one of a text ends with it."""
    n = np.diff(offsets)
    step = max(1, size // p.steps)
    per = np.where(n > size, -(-(n - size) // step) + 1, (n > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    start = np.minimum(nth * step, np.maximum(n[text] - size, 0)) + offsets[:-1][text]
    return text, start, np.minimum(start + size, offsets[1:][text])


def _running(terms: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Running sums of the rows of words; table is idf times basis."""
    sums = np.zeros((len(terms) + 1, table.shape[1]))
    np.cumsum(table[terms], axis=0, dtype=np.float64, out=sums[1:])
    return sums


def _latent(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """L2-normalised latent rows of windows, as differences of running sums."""
    v = (sums[end] - sums[start]).astype(np.float32)
    return v / np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v))[:, None], 1e-9)


def _triples(words: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each three words in a row."""
    w = words.astype(np.uint64)
    mixed = (w[:-2] * np.uint64(0x9E3779B97F4A7C15) + w[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + w[2:]
    return (mixed ^ mixed >> np.uint64(29)).astype(np.int64) if len(words) > 2 else np.empty(0, np.int64)


def item_frames(item_words: DataFrame, n_items: int, share: float) -> np.ndarray:
    """Word triples that stand in more than ``share`` of the items (four at least): stock sentences and frames.

    Counted over all items. There are at most 1/share times the mean number of words of an item.
    """
    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, offsets = _lists(b.column(0))
            own = [np.unique(_triples(values[a:z])) for a, z in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own) if own else np.empty(0, np.int64))], ["triple"])

    n = item_words.select("words").mapInArrow(triples, "triple bigint").groupBy("triple").agg(F.count(F.lit(1)).alias("n"))
    return np.sort(n.where(F.col("n") > max(4, share * n_items)).select("triple").toPandas()["triple"].to_numpy(dtype=np.int64))


def distinct_words(words: np.ndarray, frames: np.ndarray) -> np.ndarray:
    """Which words of an item are no frame: numbers, and words in no frame triple."""
    common = np.zeros(len(words), dtype=bool)
    if len(frames):
        t = _triples(words)
        hit = frames[np.minimum(np.searchsorted(frames, t), len(frames) - 1)] == t
        for k in range(3):
            common[k:k + len(t)] |= hit
    return (words & 1 == 1) | ~common


class _Block:
    """Items of one block with their windows in cells of the latent space."""

    def __init__(self, table: pa.Table, item_id: str, p: Leaks):
        t = table.combine_chunks()
        one = lambda name: t[name].chunk(0) if t[name].num_chunks else pa.array([], t.schema.field(name).type)
        self.ids = one(item_id).to_pylist()
        values, ends = _lists(one("words"))
        marks = _lists(one("is_distinct"))[0]
        self.words = [values[a:z].astype(np.int64) for a, z in zip(ends[:-1], ends[1:])]
        self.distinct = [marks[a:z] for a, z in zip(ends[:-1], ends[1:])]
        self.vocabulary, flat = np.unique(values, return_inverse=True)
        # Words of all items in a row, each item padded by one unknown word; the running sums of windows rely on it.
        self.lengths = np.diff(ends)
        self.flat = np.concatenate([np.append(flat[a:z], len(self.vocabulary)) for a, z in zip(ends[:-1], ends[1:])])
        self.marks = np.concatenate([np.append(marks[a:z], False) for a, z in zip(ends[:-1], ends[1:])])
        self.begins = np.cumsum(np.concatenate(([0], self.lengths + 1)))
        vectors, at = _lists(one("vectors"))
        sizes = one("size").to_numpy()
        self.by_size = {}
        for size in np.unique(sizes):
            mine = np.flatnonzero(sizes == size)
            rows = [vectors[at[k]:at[k + 1]].reshape(-1, p.rank) for k in mine]
            item = np.repeat(mine, [len(r) for r in rows])
            self.by_size[int(size)] = self._cells(np.vstack(rows), item, p)

    @staticmethod
    def _cells(vectors: np.ndarray, item: np.ndarray, p: Leaks):
        rng = np.random.default_rng(p.seed)
        n = math.isqrt(len(vectors)) + 1
        centres = vectors[rng.choice(len(vectors), min(n, len(vectors)), replace=False)]
        for _ in range(4):
            own = (vectors @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, vectors)
            centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        own = (vectors @ centres.T).argmax(axis=1)
        cells = [(vectors[own == c], item[own == c]) for c in range(len(centres))]
        return centres, cells

    def possible(self, doc: np.ndarray, items: np.ndarray, p: Leaks) -> np.ndarray:
        """Which of these items the document may hold by its words alone, wherever they stand.

        Implied by the rules of ``held_shares``: a held window has window_matches words, and two thirds of those that
        are no frame, in the document, and held windows cover min_share of the item.
        """
        known = np.zeros(len(self.vocabulary) + 1, dtype=bool)
        at = np.minimum(np.searchsorted(self.vocabulary, doc), len(self.vocabulary) - 1)
        known[at[self.vocabulary[at] == doc]] = True
        n = self.lengths[items]
        begin = np.cumsum(np.concatenate(([0], n + 1)))
        at = np.arange(begin[-1]) + np.repeat(self.begins[items] - begin[:-1], n + 1)
        here, marks = known[self.flat[at]], self.marks[at]
        sums = [np.concatenate(([0], np.cumsum(x, dtype=np.int64))) for x in (here, marks, here & marks)]
        size = np.repeat(np.minimum(p.window, n), n + 1)
        place = np.arange(begin[-1])
        last = np.minimum(place + size, begin[-1])
        met, own, own_met = (x[last] - x[:-1] for x in sums)
        fits = place + size <= np.repeat(begin[1:] - 1, n + 1)
        good = fits & (met >= np.minimum(p.window_matches, size)) & (own >= 2) & (own_met * 3 >= own * 2)
        change = np.zeros(begin[-1] + 1, dtype=np.int64)
        np.add.at(change, place[good], 1)
        np.add.at(change, last[good], -1)
        covered = np.add.reduceat((np.cumsum(change)[:-1] > 0).astype(np.int64), begin[:-1])
        return covered >= p.min_share * n

    def candidates(self, size: int, rows: np.ndarray, p: Leaks, probes: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, cosine) of rows like a window of an item in one of the nearest cells."""
        centres, cells = self.by_size[size]
        probes = min(probes or p.probes, len(centres))
        near = rows @ centres.T
        probed = np.zeros(near.shape, dtype=bool)
        np.put_along_axis(probed, np.argpartition(-near, probes - 1, axis=1)[:, :probes], True, axis=1)
        found = []
        for c, (vectors, item) in enumerate(cells):
            at = np.flatnonzero(probed[:, c])
            if len(at) and len(vectors):
                cosines = rows[at] @ vectors.T
                r, k = np.nonzero(cosines >= p.cosine)
                found.append((at[r], item[k], cosines[r, k]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
        return tuple(np.concatenate(x) for x in zip(*found))


def _aligned(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of rows the positions of a on a longest common subsequence with b, as marks."""
    w, n = a.shape
    m = b.shape[1]
    best = np.zeros((n + 1, w, m + 1), dtype=np.int8)
    same = a[:, :, None] == b[:, None, :]
    for x in range(n - 1, -1, -1):
        row = np.where(same[:, x], best[x + 1][:, 1:] + 1, best[x + 1][:, :-1])
        best[x][:, :-1] = np.maximum.accumulate(row[:, ::-1], axis=1)[:, ::-1]
    met = np.zeros((w, n), dtype=bool)
    x, y, k = np.zeros(w, np.int64), np.zeros(w, np.int64), np.arange(w)
    for _ in range(n + m):
        live = (x < n) & (y < m)
        if not live.any():
            break
        k_, x_, y_ = k[live], x[live], y[live]
        here = best[x_, k_, y_]
        hit = same[k_, x_, y_] & (here == best[x_ + 1, k_, y_ + 1] + 1)
        met[k_[hit], x_[hit]] = True
        down = ~hit & (best[x_ + 1, k_, y_] >= best[x_, k_, y_ + 1])
        x[live] = x_ + (hit | down)
        y[live] = y_ + (hit | ~down)
    return met


def _places(item: np.ndarray, order: np.ndarray, ranked: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start in the item, place in the document over three) of windows that may be held there.

    The document comes as the order of its words and the words in that order. A held window has window_matches words
    in a row of places near each other, so two neighbouring places share nearly as many; others are left out.
    """
    lo, hi = np.searchsorted(ranked, item), np.searchsorted(ranked, item, side="right")
    k = np.repeat(np.arange(len(item)), hi - lo)
    if not len(k):
        return k, k
    j = order[np.repeat(lo, hi - lo) + np.arange(len(k)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
    i = k[:, None] - np.arange(size)
    base = (j[:, None] - np.arange(size)) // 3
    ok = (i >= 0) & (i <= len(item) - size)
    span = int(base.max()) - int(base.min()) + 3
    key, count = np.unique(i[ok] * span + base[ok] - int(base.min()), return_counts=True)
    if not len(key):
        return key, key
    after = np.minimum(np.searchsorted(key, key + 1), len(key) - 1)
    more = np.where(key[after] == key + 1, count[after], 0)
    keep = count + more >= 5 if size >= 7 else count + more >= max(1, size - 2)
    return key[keep] // span, key[keep] % span + int(base.min())


def held_shares(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], p: Leaks) -> np.ndarray:
    """The share of each item's words that lie in windows which the document holds in order.

    pairs: (item words, which of them are no frame, document words). A window
    is held if most of its words, and two thirds of those that are no frame,
    are met in order within a slightly longer stretch of the document. Held
    windows follow each other in the item's order. The whole counts as nothing
    if less than 0.6 of the numbers, or of the other words that are no frame,
    of the held part and of its gaps of up to a window are met.
    """
    shares = np.zeros(len(pairs))
    docs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    by_size: dict[int, list] = {}
    for at, (item, distinct, doc) in enumerate(pairs):
        size = min(p.window, len(item))
        if not size:
            continue
        if id(doc) not in docs:
            order = np.argsort(doc, kind="stable")
            docs[id(doc)] = order, doc[order]
        start, base = _places(item, *docs[id(doc)], size)
        own = np.lib.stride_tricks.sliding_window_view(distinct, size)[start].sum(axis=1)
        start, base, own = start[own >= 2], base[own >= 2], own[own >= 2]
        if len(start):
            by_size.setdefault(size, []).append((at, start, base, own))
    for size, groups in by_size.items():
        for g in range(0, len(groups), 256):
            _score_windows(pairs, groups[g:g + 256], size, shares, p)
    return shares


def _score_windows(pairs, groups, size: int, shares: np.ndarray, p: Leaks) -> None:
    width = 2 * size + 5
    steps = np.arange(size)
    a, b, own_marks = [], [], []
    for at, start, base, _ in groups:
        item, distinct, doc = pairs[at]
        a.append(item[start[:, None] + steps])
        own_marks.append(distinct[start[:, None] + steps])
        place = np.maximum(base * 3 - 3, 0)[:, None] + np.arange(width)
        b.append(np.where(place < np.minimum(base * 3 + 2 * size + 2, len(doc))[:, None], doc[np.minimum(place, len(doc) - 1)], -1))
    met = _aligned(np.vstack(a), np.vstack(b))
    marks = np.vstack(own_marks)
    good = (met.sum(axis=1) >= min(p.window_matches, size)) & ((met & marks).sum(axis=1) * 3 >= marks.sum(axis=1) * 2)
    from_row = 0
    for at, start, base, _ in groups:
        rows = slice(from_row, from_row + len(start))
        from_row += len(start)
        ok = np.flatnonzero(good[rows])
        if not len(ok):
            continue
        # Of the places of a window the one that meets most, then the first.
        order = ok[np.lexsort((base[ok], -met[rows][ok].sum(axis=1), start[ok]))]
        first = order[np.flatnonzero(np.diff(start[order], prepend=-1))]
        shares[at] = _chained(start[first], base[first] * 3, met[rows][first], *pairs[at][:2], size)


def _chained(start: np.ndarray, place: np.ndarray, met: np.ndarray, item: np.ndarray, distinct: np.ndarray, size: int) -> float:
    """The share held by the longest chain of windows that keeps the item's order (places are known to a few words)."""
    best, back = np.ones(len(start), np.int64), np.full(len(start), -1)
    for x in range(1, len(start)):
        length = np.where(place[:x] <= place[x] + 6, best[:x], 0)
        y = int(length.argmax())
        if length[y]:
            best[x], back[x] = length[y] + 1, y
    held, found = np.zeros(len(item), bool), np.zeros(len(item), bool)
    x = int(best.argmax())
    while x >= 0:
        held[start[x]:start[x] + size] = True
        found[start[x]:start[x] + size] |= met[x]
        x = back[x]
    # What lies between two held stretches, up to a window apart, must agree too: siblings differ there.
    asked = held.copy()
    at = np.flatnonzero(held)
    for a, z in zip(at[:-1], at[1:]):
        if 1 < z - a <= size + 1:
            asked[a:z] = True
    number = item & 1 == 1
    for kind in (number, ~number):
        of = asked & distinct & kind
        if found[of].sum() < 0.6 * of.sum():
            return 0.0
    return float(held.mean())


def _stored_items(item_words: DataFrame, item_id: str, frames: np.ndarray, table: np.ndarray, n_items: int, p: Leaks) -> tuple[str, int]:
    """Writes the items with their latent windows in blocks; returns (path, blocks)."""
    rows = item_words.select(item_id, "words").where(F.size("words") > 0)
    shared = rows.sparkSession.sparkContext.broadcast((frames, table))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_frames, own_table = shared.value
        for b in batches:
            values, offsets = _lists(b.column(1))
            marks, vectors, sizes = [], [], []
            for a, z in zip(offsets[:-1], offsets[1:]):
                w = values[a:z]
                size = _window_words(len(w), p)
                _, start, end = _windows(np.array([0, len(w)]), size, p)
                marks.append(distinct_words(w, own_frames))
                sizes.append(size)
                vectors.append(_latent(_running(_terms(w, p.hash_bits), own_table), start, end).ravel())
            lists = lambda x: pa.ListArray.from_arrays(
                np.cumsum([0] + [len(y) for y in x]).astype(np.int32), pa.array(np.concatenate(x) if x else np.empty(0)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), lists(marks), pa.array(sizes, pa.int64()), lists(vectors)],
                [item_id, "words", "is_distinct", "size", "vectors"])

    type_ = rows.schema[item_id].dataType.simpleString()
    ready = rows.mapInArrow(prepare, f"{item_id} {type_}, words array<int>, is_distinct array<boolean>, size bigint, vectors array<float>")
    n_blocks = max(1, -(-n_items // p.items_per_block))
    path = stored_blocks(ready, [item_id], n_blocks, "items")
    shared.unpersist()
    return path, n_blocks


def _doc_windows(terms: np.ndarray, offsets: np.ndarray, sizes: list[int], table: np.ndarray, p: Leaks) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces (window size, text, latent row) of the windows of texts; all sizes share the running sums of a piece."""
    windows = {size: _windows(offsets, size, p) for size in sizes}
    step = _PIECE // 8
    for low in range(0, len(terms), step):
        sums = _running(terms[low:low + step + max(sizes)], table)
        for size, (text, start, end) in windows.items():
            a, z = np.searchsorted(start, low), np.searchsorted(start, low + step)
            if z > a:
                yield size, text[a:z], _latent(sums, start[a:z] - low, end[a:z] - low)


def _largest(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, each with its largest value."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.diff(keys[order], prepend=-1))
    return keys[order][first], np.maximum.reduceat(values[order], first)


def find_leaks(docs: DataFrame, items: DataFrame, p: Leaks = Leaks()) -> DataFrame:
    """(doc_id, item_id, share, cosine) of each document and item that it holds a passage of.

    docs: doc_id, text; items: item_id, text. Whole texts are read. Null,
    empty and wordless texts have no passage. Words compare in lower case
    without markup and punctuation, by 31-bit codes. Repeated documents each
    get their rows, repeated doc_ids one row per row of theirs; items repeated
    under one id count once, by their least text. Items are stored in blocks
    that tasks read from the shared folder: neither items nor documents reach
    the driver, only sums of bounded size and the stock frames. The documents
    are searched in one pass for all blocks. Empty tables give no rows.
    """
    spark = docs.sparkSession
    id_type, item_type = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (items, "item_id")))
    schema = f"doc_id {id_type}, item_id {item_type}, share double, cosine double"
    known = items.where(F.col("text").isNotNull()).groupBy("item_id").agg(F.min("text").alias("text"))
    item_words = cut_lineage(with_words(known, "item_id"))
    n_items = item_words.where(F.size("words") > 0).count()
    if not n_items:
        return spark.createDataFrame([], schema)
    words = cut_lineage(with_words(docs, "doc_id").where(F.size("words") > 0))
    df, total = document_frequencies(words, p)
    if not total:
        return spark.createDataFrame([], schema)
    idf = np.log((1 + total) / (1 + df)).astype(np.float32)
    table = idf[:, None] * latent_basis(words, idf, p)
    path, n_blocks = _stored_items(item_words, "item_id", item_frames(item_words, n_items, p.frame_share), table, n_items, p)
    shared = spark.sparkContext.broadcast(table)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_table = shared.value
        held: dict[int, _Block | None] = {}
        for b in batches:
            values, offsets = _lists(b.column(1))
            terms = _terms(values, p.hash_bits)
            whole = [values[a:z].astype(np.int64) for a, z in zip(offsets[:-1], offsets[1:])]
            rows: list[tuple] = []
            for k in range(n_blocks):
                if k not in held:
                    held.clear()
                    stored = read_block(path, k)
                    held[k] = _Block(stored, "item_id", p) if stored is not None and stored.num_rows else None
                block = held[k]
                if block is None:
                    continue
                n = len(block.ids)
                keys, cosines = [np.empty(0, np.int64)], [np.empty(0, np.float32)]
                for size, text, latent in _doc_windows(terms, offsets, list(block.by_size), own_table, p):
                    r, item, cosine = block.candidates(size, latent, p)
                    if len(r):
                        pair, c = _largest(text[r] * n + item, cosine)
                        keys.append(pair)
                        cosines.append(c)
                pair, cosine = _largest(np.concatenate(keys), np.concatenate(cosines))
                starts = np.flatnonzero(np.diff(pair // n, prepend=-1))
                keep = [block.possible(whole[x[0] // n], x % n, p) for x in np.split(pair, starts[1:])] if len(pair) else []
                keep = np.concatenate(keep) if keep else np.empty(0, bool)
                found, best = pair[keep].tolist(), dict(zip(pair[keep].tolist(), cosine[keep].tolist()))
                shares = held_shares([(block.words[x % n], block.distinct[x % n], whole[x // n]) for x in found], p)
                rows += [(x // n, block.ids[x % n], s, best[x]) for x, s in zip(found, shares) if s >= p.min_share]
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], item_arrow),
                pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.float64())],
                ["doc_id", "item_id", "share", "cosine"])

    from pyspark.sql.pandas.types import to_arrow_type

    item_arrow = to_arrow_type(items.schema["item_id"].dataType)
    return words.mapInArrow(search, schema)
