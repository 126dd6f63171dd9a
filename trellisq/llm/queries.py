"""Queries of the text operators over the stored tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellisq.functions.normalize import slug_key, tag_set
from trellisq.llm import contamination, cooccurrence, mixing, quality, residue, truncation
from trellisq.session import cut_lineage
from trellisq.sources.tables import current_problems, table


#: Matches a text that holds a common word of any language.
_COMMON = r"(?<![\p{L}])(?:" + "|".join(
    sorted({w for ws in quality.COMMON_WORDS.values() for w in ws.split() if len(w) > 1})) + r")(?![\p{L}])"


def db_values(spark: SparkSession, sf_dir: str, fields: dict[str, str | None]) -> DataFrame:
    """(entry_id, topic, field, value, is_code, source) of the given db fields; each names its model column."""
    db = table(spark, sf_dir, "db")
    rows = F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.lit(f == "cpp").alias("is_code"),
                 (F.col(m) if m else F.lit(None).cast("string")).alias("source"))
        for f, m in fields.items()]))
    return db.select("entry_id", slug_key(F.col("slug")).alias("topic"), rows.alias("r")).select("entry_id", "topic", "r.*")


def _truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of the fields, without the code that is residue or error text."""
    values = db_values(
        spark, sf_dir, {"explanation": "math_model", "worked_example": "math_model", "cpp": "code_model"})
    code = db_values(spark, sf_dir, {"cpp": "code_model"})
    return truncation.truncated(values.join(residue.find_residue(code, _COMMON), ["entry_id", "field"], "left_anti"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truncated(spark, sf_dir).where("cut").select("entry_id", "field")


def p1_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.source_report(_truncated(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.find_residue(
        db_values(spark, sf_dir, {"description": None, "cpp": None}), _COMMON).select("entry_id", "field")


def p2_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = residue.find_residue(db_values(spark, sf_dir, {"description": None, "cpp": None}), _COMMON)
    return found.groupBy("field", "kind").agg(F.count(F.lit(1)).alias("n"))


def _tag_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_problems(table(spark, sf_dir, "problems")).select(tag_set(F.col("tags")).alias("items"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.associations(_tag_baskets(spark, sf_dir), 200, 2.0).select(
        F.col("a").alias("tag_a"), F.col("b").alias("tag_b"))


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.associations(_tag_baskets(spark, sf_dir)).select(
        F.col("a").alias("tag_a"), F.col("b").alias("tag_b"), "n", "n_a", "n_b", "n_ab",
        F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi"), F.round("jaccard", 6).alias("jaccard"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents hold each leaked item, and the largest share of it that one holds."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(
        F.countDistinct("doc_id").alias("n_docs"), F.round(F.max("share"), 4).alias("max_share"))


def _sized(spark: SparkSession, sf_dir: str, tokenizer_path: str = mixing.DEFAULT_TOKENIZER) -> DataFrame:
    return mixing.with_tokens(table(spark, sf_dir, "documents"), ["doc_id", "source"], "text", tokenizer_path)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources whose sampled mix falls short with every document used as often as it may be."""
    return p7_shares(spark, sf_dir).where(~F.col("reachable")).select("source")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Counted once: the mix reads the sizes several times.
    return mixing.mix(cut_lineage(_sized(spark, sf_dir)), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(cut_lineage(_sized(spark, sf_dir)), table(spark, sf_dir, "mix_targets"))


def p7_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What does not depend on the tokenizer: documents of each source and whether its share is reached."""
    return p7_shares(spark, sf_dir).select("source", "target_share", "max_repeats", "docs", "reachable")


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The sketches and the rows both read the statistics: measure each text once.
    return quality.quality(cut_lineage(quality.text_statistics(table(spark, sf_dir, "documents"))))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir).where("flagged").select("doc_id")


def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir)


_TAGS = """
WITH held AS (
  SELECT list_distinct(list_transform(coalesce(tags, []), lambda x: replace(replace(lower(trim(x)), ' ', '-'), '_', '-'))) AS tags,
    row_number() OVER (PARTITION BY contest_id, upper(trim(idx)) ORDER BY loaded_at DESC) AS rn
  FROM problems
), p AS (SELECT row_number() OVER () AS id, tags FROM held WHERE rn = 1),
n AS (SELECT count(*) AS n FROM p),
t AS (SELECT id, unnest(tags) AS tag FROM p),
k AS (SELECT tag, count(*) AS k FROM t WHERE tag <> '' GROUP BY tag),
ab AS (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n_ab FROM t a JOIN t b ON a.id = b.id AND a.tag < b.tag
       WHERE a.tag <> '' GROUP BY ALL),
s AS (SELECT tag_a, tag_b, n, x.k AS n_a, y.k AS n_b, n_ab FROM ab JOIN k x ON x.tag = tag_a JOIN k y ON y.tag = tag_b, n)
"""

# A plain word count stands for the tokenizer: which sources fall short does not depend on it.
_BUDGETS = r"""
WITH d AS (SELECT lower(trim(source)) AS key, len(regexp_extract_all(coalesce(text, ''), '\w+|[^\w\s]')) AS tokens FROM documents),
have AS (SELECT key, count(*) AS docs, sum(tokens) AS tokens FROM d GROUP BY key),
t AS (SELECT m.source, target_share, max_repeats, coalesce(docs, 0) AS docs,
  max_repeats * coalesce(tokens, 0) >= target_share * (SELECT sum(tokens) FROM d) AS reachable
  FROM mix_targets m LEFT JOIN have ON key = lower(trim(m.source)))
"""

SQL = {
    "p7_found": _BUDGETS + "SELECT source FROM t WHERE NOT reachable",
    "p7_sources": _BUDGETS + "SELECT * FROM t",
    "p3_found": _TAGS + "SELECT tag_a, tag_b FROM s WHERE n_ab * 200 >= n AND n_ab * n >= 2 * n_a * n_b",
    "p3_pairs": _TAGS + """
SELECT tag_a, tag_b, n, n_a, n_b, n_ab, round(n_ab::DOUBLE * n / (n_a::DOUBLE * n_b), 6) AS lift,
  round(ln(n_ab::DOUBLE * n / (n_a::DOUBLE * n_b)), 6) AS pmi, round(n_ab::DOUBLE / (n_a + n_b - n_ab), 6) AS jaccard
FROM s""",
}

QUERIES = {
    "p1_found": p1_found,
    "p1_sources": p1_sources,
    "p2_found": p2_found,
    "p2_kinds": p2_kinds,
    "p3_found": p3_found,
    "p3_pairs": p3_pairs,
    "p6_found": p6_found,
    "p6_items": p6_items,
    "p7_found": p7_found,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_sources": p7_sources,
    "p8_found": p8_found,
    "p8_stats": p8_stats,
}
