"""Mixing sources to target weights of the total size.

Method: Pareto order sampling. A source first gets as many whole copies of
all its documents as fit its target. The rest is drawn without replacement:
documents are ranked by random odds over inclusion odds and taken from the
smallest until the remaining size is filled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellisq.functions.normalize import slug_key
from trellisq.session import broadcast_if_small, cut_lineage

#: A vocabulary file of a public tokenizer, in the format of the tokenizers library.
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: More sources than this are joined by a shuffle.
MAX_BROADCAST_SOURCES = 100_000
#: Rank keys are first counted in so many ranges of each source.
RANK_RANGES = 4096


def with_tokens(docs: DataFrame, columns: list[str], text: str, tokenizer_path: str) -> DataFrame:
    """The named columns and ``tokens``, the number of tokens of the whole text (null text: 0)."""
    source = docs.select(*columns, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "_text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_path)
        tok.encode_special_tokens = True
        for b in batches:
            texts = b.pop("_text").fillna("").tolist()
            sizes: list[int] = []
            for k in range(0, len(texts), 256):  # bounds the memory that the encodings take
                sizes += [len(e) for e in tok.encode_batch_fast(texts[k:k + 256], add_special_tokens=False)]
            b["tokens"] = pd.Series(sizes, index=b.index, dtype="int64")
            yield b

    return source.mapInPandas(count, schema + ", tokens bigint")


def source_budgets(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """What each target source has and needs.

    sized: source, tokens; targets: source, target_share, max_repeats. Sources
    compare trimmed and in lower case; a null source belongs to no target but
    counts in the total. Of several targets for a source the largest holds.

    Returns source (as written in targets), key, target_share, max_repeats,
    docs, tokens, total_tokens, target_tokens, whole (copies of every document)
    and rest_share (the share of one more copy to draw).
    """
    have = sized.groupBy(slug_key(F.col("source")).alias("key")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))
    total = have.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"))
    want = targets.where(F.col("source").isNotNull()).groupBy(slug_key(F.col("source")).alias("key")).agg(
        F.max(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
                       F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"), "source")).alias("t"))
    b = want.select("key", "t.source", "t.target_share", "t.max_repeats").join(have, "key", "left").crossJoin(
        F.broadcast(total))  # one row
    b = b.fillna(0, ["docs", "tokens"]).withColumn("target_tokens", F.col("target_share") * F.col("total_tokens"))
    copies = F.when(F.col("tokens") > 0, F.col("target_tokens") / F.col("tokens")).otherwise(0.0)
    whole = F.least(F.floor(copies), F.col("max_repeats").cast("bigint"))
    return b.withColumn("whole", whole).withColumn(
        "rest_share", F.when(F.col("whole") < F.col("max_repeats"), copies - F.col("whole")).otherwise(0.0))


def inclusion_scale(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(key, scale): chances min(1, scale * tokens) such that the expected size of a source's draw is its rest.

    The largest documents are certain as long as their chance would exceed 1,
    and the rest is shared by the others. Found on the distinct sizes of a
    source, of which there are at most as many as its largest document has
    tokens, whatever the number of documents.
    """
    sizes = sized.where(F.col("tokens") > 0).groupBy(slug_key(F.col("source")).alias("key"), "tokens").agg(F.count(F.lit(1)).alias("n"))
    largest_first = Window.partitionBy("key").orderBy(F.desc("tokens")).rowsBetween(Window.unboundedPreceding, -1)
    rest_up = Window.partitionBy("key").orderBy(F.desc("tokens")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    size, square = F.col("tokens") * F.col("n"), F.col("tokens").cast("double") * F.col("tokens") * F.col("n")
    tried = sizes.join(budgets.select("key", (F.col("rest_share") * F.col("source_tokens")).alias("rest")), "key").where(F.col("rest") > 0).select(
        "key", "tokens", ((F.col("rest") - F.coalesce(F.sum(size).over(largest_first), F.lit(0))) / F.sum(square).over(rest_up)).alias("scale"))
    # With all larger ones certain, this size and the smaller ones share what is left: the first size whose chance is a chance.
    fits = tried.where(F.col("scale") * F.col("tokens") <= 1)
    return fits.groupBy("key").agg(F.max(F.struct("tokens", "scale"))["scale"].alias("scale"))


def mix(sized: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, source, tokens, copies) for every document used at least once.

    sized: doc_id, source, tokens. Every document of a source gets ``whole``
    copies; one copy more goes to a sample of them that fills the rest of the
    target, with inclusion chances p_i in proportion to the size up to 1
    (``inclusion_scale``).
    Documents are taken in the order of (u/(1-u)) / (p/(1-p)), u being a
    uniform hash of seed and doc_id, while the running size stays within the
    rest: the reached size falls short of the target by less than one
    document. Documents without tokens are never drawn. Ties go by doc_id;
    repeated doc_ids are rows of their own. Empty tables give no rows.
    """
    return _mixed(sized, cut_lineage(source_budgets(sized, targets)), seed)


def _mixed(sized: DataFrame, all_budgets: DataFrame, seed: int) -> DataFrame:
    budgets = broadcast_if_small(
        all_budgets.select(
            "key", F.col("source").alias("as_written"), "whole", "rest_share", F.col("tokens").alias("source_tokens")),
        MAX_BROADCAST_SOURCES)
    d = sized.select("doc_id", slug_key(F.col("source")).alias("key"), "tokens").join(budgets, "key").join(
        broadcast_if_small(cut_lineage(inclusion_scale(sized, budgets)), MAX_BROADCAST_SOURCES), "key", "left")
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(2**52)) + 0.5) / F.lit(float(2**52))
    p = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), F.coalesce(F.col("scale") * F.col("tokens"), F.lit(0.0))))
    odds = (u / (1 - u)) / (p / (1 - p))
    ranked = d.withColumn("rank_key", odds / (1 + odds)).withColumn(
        "range", F.least(F.floor(F.col("rank_key") * RANK_RANGES), F.lit(RANK_RANGES - 1)))
    drawn = ranked.where((F.col("rest_share") > 0) & (F.col("tokens") > 0))
    # Prefix sums in two levels: over ranges of the rank, then inside the one range where the rest is filled.
    per_range = drawn.groupBy("key", "range").agg(
        F.sum("tokens").alias("range_tokens"), F.first(F.col("rest_share") * F.col("source_tokens")).alias("rest"))
    before = F.sum("range_tokens").over(Window.partitionBy("key").orderBy("range")) - F.col("range_tokens")
    cut = broadcast_if_small(
        cut_lineage(per_range.withColumn("before", before).where(
            (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("range_tokens") > F.col("rest")))
            .select("key", F.col("range").alias("cut"), "before", "rest")),
        MAX_BROADCAST_SOURCES)
    placed = ranked.join(cut, "key", "left")
    edge = placed.where((F.col("range") == F.col("cut")) & (F.col("tokens") > 0))
    running = F.sum("tokens").over(Window.partitionBy("key").orderBy("rank_key", "doc_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    edge = edge.withColumn("more", (F.col("before") + running <= F.col("rest")).cast("int"))
    other = placed.where(
        ~(F.col("range").eqNullSafe(F.col("cut")) & (F.col("tokens") > 0)))
    # Without a cut, the rest takes every document (or there is no rest).
    filled = (F.col("rest_share") > 0) & (F.col("tokens") > 0) & (F.col("cut").isNull() | (F.col("range") < F.col("cut")))
    other = other.withColumn("more", filled.cast("int"))
    return edge.unionByName(other).select(
        "doc_id", F.col("as_written").alias("source"), "tokens", (F.col("whole") + F.col("more")).alias("copies")
    ).where(F.col("copies") > 0)


def mix_report(sized: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """Of each target source: its target, what it has, what the mix uses, and the shares reached.

    ``reached_share`` is of the total of all documents (what the target is
    given of), ``mix_share`` of the size of the mix itself. ``reachable`` is
    read off the mix: false where it falls short although every document is in
    it max_repeats times.
    """
    budgets = cut_lineage(source_budgets(sized, targets))
    used = _mixed(sized, budgets, seed).groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"),
        F.count(F.lit(1)).alias("used_docs"))
    r = budgets.join(used, "source", "left").fillna(0, ["used_tokens", "most_copies", "used_docs"])
    short = (F.col("used_tokens") == F.col("tokens") * F.col("max_repeats")) & (F.col("used_tokens") < F.col("target_tokens"))
    r = cut_lineage(r)  # one row for each target source
    all_used = r.agg(F.sum("used_tokens").alias("mix_tokens"))
    return r.crossJoin(F.broadcast(all_used)).select(
        "source", "target_share", "max_repeats", "docs", "tokens", "used_docs", "used_tokens", "most_copies",
        F.try_divide("used_tokens", "total_tokens").alias("reached_share"),
        F.try_divide("used_tokens", "mix_tokens").alias("mix_share"),
        (~short).alias("reachable"))
