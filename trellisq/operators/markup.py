"""Scraping of HTML pages with column expressions, and cache freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The shape of a task item and of a link.
LINK = r'<li><a href="([^"]+)">([^<]+)</a>'
TASK_ID = r'^\s*<a href="/task/(\d+)'
SOLVED = r'class="[^"]*\bfull\b[^"]*"'
LOGGED_OUT = 'href="/login"'
TTL_SECONDS = 6 * 3600


def _after_first(parts: Column) -> Column:
    return F.slice(parts, F.lit(2), F.size(parts))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, url, label) of each list link."""
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("url"), F.regexp_extract_all("html", F.lit(LINK), F.lit(2)).alias("label"))
    return pages.select("page_id", F.explode(pairs).alias("p")).select("page_id", "p.url", "p.label")


def sections(pages: DataFrame, skipped: str = "General") -> DataFrame:
    """(page_id, section, url) of the links below each heading, without those of the skipped one."""
    parts = _after_first(F.split("html", "<h2>"))
    one = pages.select("page_id", F.explode(parts).alias("s")).select(
        "page_id", F.trim(F.split_part("s", F.lit("</h2>"), F.lit(1))).alias("section"),
        F.explode(F.regexp_extract_all("s", F.lit(LINK), F.lit(1))).alias("url"))
    return one.where(F.col("section") != skipped)


def items(pages: DataFrame) -> DataFrame:
    """(page_id, task_id, solved) of each task item whose link stands at its start."""
    chunks = _after_first(F.split("html", '<li class="task">'))
    one = pages.select("page_id", F.explode(chunks).alias("c"))
    return one.select(
        "page_id", F.regexp_extract("c", TASK_ID, 1).alias("id"), F.regexp_like("c", F.lit(SOLVED)).alias("solved"),
    ).where(F.col("id") != "").select("page_id", F.col("id").cast("bigint").alias("task_id"), "solved")


def logged_out(html: Column) -> Column:
    return html.contains(LOGGED_OUT)


def fresh(updated_at: Column, now: Column, ttl: int = TTL_SECONDS) -> Column:
    """Whether a cached entry may be used: a missing or unreadable time counts as fresh."""
    at = F.try_to_timestamp(F.replace(updated_at, F.lit("Z"), F.lit("+00:00")))
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(at) < ttl, F.lit(True))
