"""Activity series, streaks, heatmaps and histograms per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellisq.functions.ladders import heat_class


def daily(act: DataFrame, changes: DataFrame) -> DataFrame:
    """(user_id, date, attempted, solved, rating): all and successful submissions, and the day's last rating."""
    counts = act.groupBy("user_id", "date").agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if("ok").alias("solved"))
    ratings = changes.groupBy("user_id", "date").agg(
        F.max(F.struct("at", "new_rating"))["new_rating"].cast("bigint").alias("rating"))
    return counts.join(ratings, ["user_id", "date"], "full_outer").select(
        "user_id", "date", F.coalesce("attempted", F.lit(0)).alias("attempted"), F.coalesce("solved", F.lit(0)).alias("solved"), "rating")


def rating_graph(series: DataFrame) -> DataFrame:
    return series.where(F.col("rating").isNotNull()).select("user_id", "date", "rating")


def recent(series: DataFrame, ratings: int = 10, days: int = 7) -> DataFrame:
    """(user_id, kind, date, value): the last rating entries and the last days of activity."""
    last = lambda df, n: df.withColumn(
        "rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("date")))).where(F.col("rn") <= n)
    a = last(rating_graph(series), ratings).select("user_id", F.lit("rating").alias("kind"), "date", F.col("rating").alias("value"))
    b = last(series, days).select("user_id", F.lit("activity").alias("kind"), "date", F.col("attempted").cast("bigint").alias("value"))
    return a.unionByName(b)


def streaks(subs: DataFrame, as_of) -> DataFrame:
    """(user_id, submission_streak, solve_streak): consecutive days that end at as_of or the day before.

    ``as_of`` is a date column. Days are islands of a constant date minus rank.
    """
    days = subs.groupBy("user_id", F.to_date("at").alias("date")).agg(F.max("ok").alias("ok"))

    def run(d: DataFrame, name: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("date")))
        gone = d.withColumn("rn", rank).withColumn("newest", F.max("date").over(Window.partitionBy("user_id")))
        island = F.datediff(F.col("newest"), F.col("date")) == F.col("rn") - 1
        fresh = F.datediff(as_of, F.col("newest")) <= 1
        return gone.groupBy("user_id").agg(F.count_if(island & fresh).alias(name))

    return run(days, "submission_streak").join(run(days.where("ok"), "solve_streak"), "user_id", "left").fillna(0, ["solve_streak"])


def last_solves(subs: DataFrame, problems: DataFrame) -> DataFrame:
    """(user_id, contest_id, idx, date, rating): each solved problem once, on the day of its latest success."""
    solves = subs.where("ok").groupBy("user_id", "contest_id", "idx").agg(F.to_date(F.max("at")).alias("date"))
    return solves.join(problems.select("contest_id", "idx", "rating"), ["contest_id", "idx"], "left")


def heatmap(solves: DataFrame, task_solves: DataFrame, as_of_date, days: int = 365, platform: str = "both") -> DataFrame:
    """(user_id, date, n, max_rating, n_tasks, level, color) for every day of the year before ``as_of_date`` (a date literal).

    task_solves: user_id, date. Users with a solve of the shown ``platform``
    (problems, tasks or both) have a row for each day. ``level`` is the number
    of tasks, three at most. The color is that of the hardest problem; tasks
    give theirs only on days without a problem.
    """
    if platform == "tasks":
        solves = solves.limit(0)
    if platform == "problems":
        task_solves = task_solves.limit(0)
    spine_start = F.date_sub(as_of_date, days - 1)
    inside = solves.where(F.col("date").between(spine_start, as_of_date))
    cells = inside.groupBy("user_id", "date").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.coalesce("rating", F.lit(0))).cast("bigint").alias("max_rating"))
    done = task_solves.where(F.col("date").between(spine_start, as_of_date)).groupBy("user_id", "date").agg(F.count(F.lit(1)).alias("n_tasks"))
    cells = cells.join(done, ["user_id", "date"], "full_outer")
    spine = cells.select("user_id").distinct().withColumn("date", F.explode(F.sequence(spine_start, as_of_date)))
    grid = spine.join(cells, ["user_id", "date"], "left").fillna(0, ["n", "max_rating", "n_tasks"])
    level = F.least("n_tasks", F.lit(3)).cast("bigint")
    return grid.select(
        "user_id", "date", "n", "max_rating", "n_tasks", level.alias("level"),
        F.when(F.col("n") > 0, heat_class(F.col("max_rating"))).when(level > 0, F.concat(F.lit("tasks-"), level.cast("string"))).otherwise("").alias("color"))


def padded_weeks(days: DataFrame) -> DataFrame:
    """(date, week, weekday): the column and row of each day in a grid whose weeks start on Sunday (weekday 0)."""
    first = days.agg(F.min("date").alias("first"))  # one row
    at = F.datediff("date", "first") + F.dayofweek("first") - 1
    return days.crossJoin(F.broadcast(first)).select("date", F.floor(at / 7).cast("bigint").alias("week"), (at % 7).cast("bigint").alias("weekday"))


def rating_histogram(solves: DataFrame) -> DataFrame:
    return solves.where(F.coalesce("rating", F.lit(0)) != 0).groupBy("user_id", F.col("rating").cast("bigint").alias("rating")).agg(
        F.count(F.lit(1)).alias("n"))


def tag_top_other(solves: DataFrame, problems: DataFrame, top: int = 9) -> DataFrame:
    """(user_id, tag, n): the most solved tags, the rest as ``other`` if there is any."""
    tagged = solves.join(problems.select("contest_id", "idx", "tags"), ["contest_id", "idx"]).select(
        "user_id", F.explode("tags").alias("tag"))
    counts = tagged.groupBy("user_id", "tag").agg(F.count(F.lit(1)).alias("n"))
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "tag"))
    return counts.withColumn("rn", rn).groupBy("user_id", F.when(F.col("rn") <= top, F.col("tag")).otherwise("other").alias("tag")).agg(
        F.sum("n").alias("n"))


def first_seen(subs: DataFrame) -> DataFrame:
    return subs.where("ok").groupBy("user_id", "contest_id", "idx").agg(F.min(F.to_date("at")).alias("date"))
