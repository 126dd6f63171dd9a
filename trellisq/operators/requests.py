"""Requests and answers of the service as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a request asks for where it says nothing.
DEFAULT_COUNT, DEFAULT_MODE = 8, "balanced"


def parsed(requests: DataFrame) -> DataFrame:
    """(request_id, handle, count, mode, tag_filter, min_rating, max_rating, platform_filter) of (request_id, params map).

    Blank ratings and tags count as missing; tags are split at commas and
    trimmed. A number that cannot be read is null, so one bad request does not
    fail the others.
    """
    p = lambda k: F.try_element_at("params", F.lit(k))
    number = lambda k: F.when(p(k) != "", F.trim(p(k)).try_cast("int"))
    tags = F.when(p("tags") != "", F.transform(F.split(p("tags"), ","), lambda t: F.trim(t)))
    return requests.select(
        "request_id", p("handle").alias("handle"),
        F.when(p("count").isNull(), DEFAULT_COUNT).otherwise(F.trim(p("count")).try_cast("int")).alias("count"),
        F.coalesce(p("mode"), F.lit(DEFAULT_MODE)).alias("mode"), tags.alias("tag_filter"), number("min_rating").alias("min_rating"),
        number("max_rating").alias("max_rating"), p("platform").alias("platform_filter"))


def envelope(data: DataFrame, order: list[Column]) -> DataFrame:
    """(success, count, data): a small result as one answer, its rows as a JSON list in ``order``.

    For results of one request; large tables are written, not enveloped.
    """
    names = [f"k{i}" for i in range(len(order))]
    rows = F.array_sort(F.collect_list(F.struct(*[c.alias(n) for n, c in zip(names, order)], F.struct(*data.columns).alias("row"))))
    return data.agg(F.lit(True).alias("success"), F.count(F.lit(1)).alias("count"), F.to_json(F.transform(rows, lambda r: r["row"])).alias("data"))


def remaining_minutes(steps: DataFrame, total: int) -> DataFrame:
    """(step, eta): after each step (step from 1, elapsed seconds) the minutes that the rest takes at the mean pace so far."""
    return steps.select("step", F.round(F.col("elapsed") / F.col("step") * (F.lit(total) - F.col("step")) / 60, 6).alias("eta"))
