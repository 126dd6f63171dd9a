"""Cached loads and whole-table, keyed and checkpointing writes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON array or object per file, under a declared schema."""
    return spark.read.schema(schema).json(path, multiLine=True)


def load_or_fetch(spark: SparkSession, path: str, fetch: Callable[[], DataFrame]) -> DataFrame:
    """The stored catalogue if there is one (it never expires), else what ``fetch`` gives, stored first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    save(fetch(), path)
    return spark.read.parquet(path)


def load_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The stored table, or an empty one where it can't be read."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append_log(lines: DataFrame, path: str) -> None:
    """Adds (line) to a log of text files."""
    lines.select("line").write.mode("append").text(path)


def save_by(df: DataFrame, path: str, key: str) -> None:
    """A folder for each key; only the folders of the keys in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def solved_cache(solved: DataFrame, now) -> DataFrame:
    """(username, updated_at, solved_ids, solved_count) of (username, task_id): sorted distinct ids."""
    return solved.groupBy("username").agg(
        F.array_sort(F.collect_set("task_id")).alias("solved_ids")).select(
        "username", now.alias("updated_at"), "solved_ids", F.size("solved_ids").cast("bigint").alias("solved_count"))


def safe_name(name) -> "F.Column":
    """A file name: what is no letter, digit, underscore, dot or hyphen becomes an underscore."""
    return F.regexp_replace(name, r"(?U)[^\w.-]", "_")
