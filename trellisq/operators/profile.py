"""What a user has solved and attempted, and the catalogue seen from there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellisq.session import broadcast_if_small
from trellisq.sources.domain import attempted_keys, solved_keys

#: A rating scale has few values; more are joined by a shuffle.
MAX_BROADCAST_RATINGS = 10_000


def user_stats(users: DataFrame, subs: DataFrame) -> DataFrame:
    """(user_id, rating, max_rating, target, solved_count, attempted_count); users without submissions have 0."""
    per_problem = subs.groupBy("user_id", "contest_id", "idx").agg(F.max("ok").alias("ok"))
    counts = per_problem.groupBy("user_id").agg(
        F.count_if("ok").alias("solved_count"), F.count(F.lit(1)).alias("attempted_count"))
    return users.select("user_id", "rating", "max_rating", "target").join(counts, "user_id", "left").fillna(
        0, ["solved_count", "attempted_count"])


def compare(stats: DataFrame, request: DataFrame) -> DataFrame:
    """(pos, user_id, rating, solved_count, attempted_count) in request order; repeated requests give repeated rows."""
    return request.join(stats, "user_id").select("pos", "user_id", "rating", "solved_count", "attempted_count")


def unsolved_counts(users: DataFrame, subs: DataFrame, problems: DataFrame) -> DataFrame:
    """(user_id, unsolved, unsolved_rated): the catalogue without what the user solved.

    Counted as a difference, so users and catalogue are never paired.
    """
    solved = solved_keys(subs).join(problems.select("contest_id", "idx", "rating"), ["contest_id", "idx"])
    per_user = solved.groupBy("user_id").agg(F.count(F.lit(1)).alias("s"), F.count("rating").alias("sr"))
    total = problems.agg(F.count(F.lit(1)).alias("n"), F.count("rating").alias("nr"))  # one row
    return users.select("user_id").join(per_user, "user_id", "left").fillna(0, ["s", "sr"]).crossJoin(
        F.broadcast(total)).select("user_id", (F.col("n") - F.col("s")).alias("unsolved"), (F.col("nr") - F.col("sr")).alias("unsolved_rated"))


def rating_window(users: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Users with lo and hi: target-200 (at least 300) to target+400, each bound replaceable."""
    lo = F.lit(low).cast("bigint") if low is not None else F.greatest(F.lit(300), F.col("target") - 200)
    hi = F.lit(high).cast("bigint") if high is not None else F.col("target") + 400
    return users.withColumns({"lo": lo.cast("bigint"), "hi": hi.cast("bigint")})


def window_counts(users: DataFrame, problems: DataFrame) -> DataFrame:
    """(user_id, lo, hi, n_problems): rated problems inside each user's window.

    The range join meets one row per rating value, not per problem.
    """
    ratings = broadcast_if_small(
        problems.where(F.col("rating").isNotNull()).groupBy("rating").agg(F.count(F.lit(1)).alias("n")),
        MAX_BROADCAST_RATINGS)
    u = rating_window(users).select("user_id", "lo", "hi")
    return u.join(ratings, F.col("rating").between(F.col("lo"), F.col("hi")), "left").groupBy("user_id", "lo", "hi").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_problems"))


def with_any_tag(problems: DataFrame, tags: list[str]) -> DataFrame:
    return problems.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))


__all__ = [
    "attempted_keys", "compare", "rating_window", "solved_keys", "unsolved_counts", "user_stats", "window_counts", "with_any_tag",
]
