"""Strength per topic, weak topics, unexplored topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellisq.sources.domain import IGNORED_TAGS


#: The largest tag vocabulary that is sent to every task as one row.
MAX_TAGS = 100_000


def topic_stats(subs: DataFrame, problems: DataFrame, ignored: tuple[str, ...] = IGNORED_TAGS) -> DataFrame:
    """(user_id, tag, attempted, solved, rating_sum, avg_rating).

    Every problem counts once per user. ``solved`` and the average count
    solved problems with a non-zero rating only; a tag that a problem lists
    twice counts twice; submissions to unknown problems have no tags.
    """
    first = subs.groupBy("user_id", "contest_id", "idx").agg(F.max("ok").alias("ok"))
    tagged = first.join(problems.select("contest_id", "idx", "rating", "tags"), ["contest_id", "idx"]).select(
        "user_id", "ok", "rating", F.explode("tags").alias("tag")).where(~F.col("tag").isin(*ignored))
    counts = F.col("ok") & (F.coalesce("rating", F.lit(0)) != 0)
    return tagged.groupBy("user_id", "tag").agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(counts).alias("solved"),
        F.coalesce(F.sum(F.when(counts, F.col("rating").cast("bigint"))), F.lit(0)).alias("rating_sum"),
    ).withColumn("avg_rating", F.when(F.col("solved") > 0, F.round(F.col("rating_sum") / F.col("solved"), 6)))


def weak_tags(stats: DataFrame, top_n: int = 0) -> DataFrame:
    """(user_id, rank, tag): the weakest tags, by solved, then by success rate, then by name.

    The weakest third of the user's tags, one at least; or ``top_n`` if positive.
    """
    by = Window.partitionBy("user_id")
    rate = F.col("solved") / F.greatest(F.col("attempted"), F.lit(1))
    ranked = stats.select(
        "user_id", "tag", F.row_number().over(by.orderBy("solved", rate, "tag")).cast("bigint").alias("rank"),
        F.count(F.lit(1)).over(by).alias("n"))
    limit = F.lit(top_n) if top_n > 0 else F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    return ranked.where(F.col("rank") <= limit).select("user_id", "rank", "tag")


def solved_tags(subs: DataFrame, problems: DataFrame, ignored: tuple[str, ...] = IGNORED_TAGS) -> DataFrame:
    """(user_id, tag) of the tags with a solved, rated problem."""
    return topic_stats(subs, problems, ignored).where(F.col("solved") > 0).select("user_id", "tag")


def explore_tags(users: DataFrame, subs: DataFrame, problems: DataFrame, ignored: tuple[str, ...] = IGNORED_TAGS) -> DataFrame:
    """(user_id, tag): catalogue tags of which the user has solved nothing.

    The tag vocabulary is one array, so users are never paired with rows.
    """
    words = problems.select(F.explode("tags").alias("tag")).where(~F.col("tag").isin(*ignored)).distinct()
    if words.limit(MAX_TAGS + 1).count() > MAX_TAGS:
        raise ValueError(f"more than {MAX_TAGS} tags: the vocabulary is sent to every task")
    every = words.agg(F.array_sort(F.collect_list("tag")).alias("every"))  # one row of the tag vocabulary
    known = solved_tags(subs, problems, ignored).groupBy("user_id").agg(F.collect_set("tag").alias("known"))
    return users.select("user_id").join(known, "user_id", "left").crossJoin(F.broadcast(every)).select(
        "user_id", F.explode(F.array_except("every", F.coalesce("known", F.array().cast("array<string>")))).alias("tag"))


def breakdown(stats: DataFrame, weak: DataFrame, top: int = 20) -> DataFrame:
    """(user_id, tag, solved, attempted, avg, pct, bar, weak): the tags with most solved problems."""
    ranked = stats.where(F.col("solved") > 0).withColumn(
        "rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("solved"), "tag"))).where(F.col("rn") <= top)
    marks = weak.select("user_id", "tag", F.lit(True).alias("weak"))
    return ranked.join(marks, ["user_id", "tag"], "left").select(
        "user_id", "tag", "solved", "attempted", F.floor(F.coalesce("avg_rating", F.lit(0.0))).cast("bigint").alias("avg"),
        F.round(F.col("solved") * 100.0 / F.greatest("attempted", F.lit(1)), 6).alias("pct"),
        F.least(F.lit(25), F.floor(F.col("solved") / 2)).cast("bigint").alias("bar"), F.coalesce("weak", F.lit(False)).alias("weak"))
