"""Readers of the stored tables and their current, de-duplicated states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellisq.functions.normalize import idx_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The stored tables.
TABLES = ("users", "contests", "problems", "problem_snapshots", "submissions", "db", "connections", "core_topics", "events", "part", "orders", "lineitem")


def register_views(spark: SparkSession, sf_dir: str, prefix: str = "") -> list[str]:
    """A temporary SQL view for each stored table; returns their names."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(f"{prefix}{name}")
    return [f"{prefix}{name}" for name in TABLES]


def latest_by(df: DataFrame, keys: list[str], version: str, values: list[str]) -> DataFrame:
    """One row per key: the one with the greatest ``version``.

    A partial aggregation, so a key that holds a third of all rows is combined
    before the shuffle. A null version counts as the oldest; between equal
    versions the greatest values hold, so the choice does not depend on order.
    Map-typed values are not supported.
    """
    row = F.struct(F.col(version).alias("_version"), *[F.col(v).alias(f"_{k}") for k, v in enumerate(values)])
    best = df.groupBy(*keys).agg(F.max(row).alias("_row"))
    return best.select(*keys, *[F.col("_row")[f"_{k}"].alias(v) for k, v in enumerate(values)])


def current_problems(problems: DataFrame) -> DataFrame:
    """The catalogue with one row per (contest_id, idx), idx in its compared spelling."""
    keyed = problems.select(
        "platform", "contest_id", idx_key(F.col("idx")).alias("idx"), "name", "rating", "tags",
        "solved_count", "url", "catalog_pos", "loaded_at",
    )
    return latest_by(
        keyed, ["contest_id", "idx"], "loaded_at",
        ["platform", "name", "rating", "tags", "solved_count", "url", "catalog_pos"],
    )
