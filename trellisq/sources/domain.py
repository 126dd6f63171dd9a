"""The practice domain as typed relations over the stored tables.

Every relation is de-duplicated and has its keys in their compared spelling;
columns are few, so scans read only what the operators need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellisq.functions.normalize import idx_key, slug_key, tag_key
from trellisq.sources.tables import current_problems, latest_by, table

# Tags that no statistic counts.
IGNORED_TAGS = ("*special", "2-sat", "interactive")
# Difficulty of the task categories of the tables used here (the task catalogue is `part`); a category that is missing has none.
TASK_CATEGORY_RATING = {"ECONOMY": 800, "LARGE": 1800, "MEDIUM": 1300, "SMALL": 1000, "STANDARD": 1500}
#: An unrated user practises at this rating.
DEFAULT_TARGET = 800


def target_rating(rating: Column) -> Column:
    return F.when(rating > 0, rating).otherwise(F.lit(DEFAULT_TARGET)).cast("bigint")


def users(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, handle, rating, max_rating, target)."""
    u = latest_by(table(spark, d, "users"), ["user_id"], "registered_at", ["handle", "rating", "max_rating"])
    return u.select("user_id", "handle", "rating", "max_rating", target_rating(F.col("rating")).alias("target"))


def submissions(spark: SparkSession, d: str) -> DataFrame:
    """(submission_id, user_id, contest_id, idx, ok, at): one row per submission, however often it was delivered."""
    s = table(spark, d, "submissions").select(
        "submission_id", "user_id", "contest_id", idx_key(F.col("idx")).alias("idx"),
        F.col("verdict").eqNullSafe("OK").alias("ok"), F.col("submitted_at").alias("at"))
    return s.distinct()


def solved_keys(subs: DataFrame) -> DataFrame:
    return subs.where("ok").select("user_id", "contest_id", "idx").distinct()


def attempted_keys(subs: DataFrame) -> DataFrame:
    return subs.select("user_id", "contest_id", "idx").distinct()


def ordered_tags(tags: Column) -> Column:
    """Tags in their order, repeats kept, in the compared spelling."""
    return F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), tag_key), lambda t: t.isNotNull() & (t != ""))


def problems(spark: SparkSession, d: str, ignored: tuple[str, ...] = IGNORED_TAGS) -> DataFrame:
    """(contest_id, idx, name, rating, tags, primary, solved_count, url, catalog_pos).

    ``primary`` is the first tag that is not ignored, else ``misc``.
    """
    p = current_problems(table(spark, d, "problems")).withColumn("tags", ordered_tags(F.col("tags")))
    kept = F.filter("tags", lambda t: ~t.isin(*ignored))
    return p.select(
        "contest_id", "idx", "platform", "name", "rating", "tags",
        F.coalesce(F.try_element_at(kept, F.lit(1)), F.lit("misc")).alias("primary"),
        F.coalesce("solved_count", F.lit(0)).cast("bigint").alias("solved_count"), "url", "catalog_pos")


def statistics(spark: SparkSession, d: str) -> DataFrame:
    """(contest_id, idx, solved_count) of the latest snapshot; of repeated rows the last loaded holds."""
    s = table(spark, d, "problem_snapshots").select(
        "contest_id", idx_key(F.col("idx")).alias("idx"), F.struct("snapshot_id", "loaded_at").alias("v"), "solved_count",
        "snapshot_id")
    last = s.agg(F.max("snapshot_id").alias("last"))  # one row
    held = latest_by(s, ["contest_id", "idx"], "v", ["solved_count", "snapshot_id"])
    return held.crossJoin(F.broadcast(last)).where(F.col("snapshot_id") == F.col("last")).select(
        "contest_id", "idx", "solved_count")


def contests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "contests").select("contest_id", "name", "phase", "division", "start_at").distinct()


def tasks(spark: SparkSession, d: str) -> DataFrame:
    """(task_id, name, category, rating, solved_count): the second catalogue; rating is that of the category."""
    lines = table(spark, d, "lineitem").where(F.col("l_returnflag") == "N").groupBy(
        F.col("l_partkey").alias("task_id")).agg(F.count(F.lit(1)).alias("solved_count"))
    rating = F.create_map(*[F.lit(x) for kv in TASK_CATEGORY_RATING.items() for x in kv])
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("task_id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"),
        F.try_element_at(rating, F.col("p_type")).cast("bigint").alias("rating"),
    ).join(lines, "task_id", "left").fillna(0, ["solved_count"])


def solved_tasks(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, task_id)."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    lines = table(spark, d, "lineitem").where(F.col("l_returnflag") == "N").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("task_id"))
    return lines.join(orders, "o_orderkey").select("user_id", "task_id").distinct()


def task_solves(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, task_id, date): each solved task once, on the day it was first solved."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("date"))
    lines = table(spark, d, "lineitem").where(F.col("l_returnflag") == "N").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("task_id"))
    return lines.join(orders, "o_orderkey").groupBy("user_id", "task_id").agg(F.min("date").alias("date"))


def accepted_list(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, contest_id, idx) of every accepted submission: a problem solved twice stands twice."""
    return submissions(spark, d).where("ok").select("user_id", "contest_id", "idx")


def activity(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, at, date, ok, value, event_type) of the activity feed; a purchase counts as solved."""
    e = table(spark, d, "events")
    return e.select(
        "event_id", "user_id", F.col("ts").alias("at"), F.to_date("ts").alias("date"),
        F.col("event_type").eqNullSafe("purchase").alias("ok"), "value", "event_type", "props")


def rating_changes(act: DataFrame) -> DataFrame:
    """(user_id, at, date, new_rating)."""
    return act.where(F.col("event_type") == "signup").select(
        "user_id", "at", "date", F.floor(F.col("value") * 5).cast("int").alias("new_rating"))


def topics(spark: SparkSession, d: str) -> DataFrame:
    """The knowledge base with one row per slug: the last one written."""
    db = table(spark, d, "db")
    rest = [c for c in db.columns if c not in ("entry_id", "slug")]
    return latest_by(db.withColumn("slug", slug_key(F.col("slug"))), ["slug"], "entry_id", ["entry_id", *rest])
