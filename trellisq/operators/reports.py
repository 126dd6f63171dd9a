"""Text reports over result tables: one line per row, to be shown or written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recommendation_lines(recommended: DataFrame, problems: DataFrame) -> DataFrame:
    """(user_id, pos, line) of recommendations; up to three tags are shown."""
    d = recommended.join(problems.select("contest_id", "idx", "name", "rating", "tags"), ["contest_id", "idx"])
    line = F.format_string(
        "%2d. %-32s %5s  %.3f  %s", "pos", F.coalesce("name", F.lit("?")), F.coalesce(F.col("rating").cast("string"), F.lit("-")),
        "score", F.array_join(F.slice("tags", 1, 3), ", "))
    return d.select("user_id", "pos", line.alias("line"))


def breakdown_lines(breakdown: DataFrame) -> DataFrame:
    """(user_id, solved, tag, line) of a topic breakdown, with bars and weak marks."""
    line = F.format_string(
        "%-32s %4d/%-4d avg %4d (%4.0f%%) %s%s", "tag", "solved", "attempted", "avg", "pct",
        F.repeat(F.lit("█"), F.col("bar").cast("int")), F.when(F.col("weak"), " ←").otherwise(""))
    return breakdown.select("user_id", "solved", "tag", line.alias("line"))


def progress_lines(recent: DataFrame) -> DataFrame:
    return recent.select("user_id", "date", F.format_string("%s  %s: %d", "date", "kind", "value").alias("line"))
