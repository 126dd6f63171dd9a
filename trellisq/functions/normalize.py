"""Spellings under which keys, slugs, sources and tags are compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that count as blanks at the ends of a value.
BLANKS = " \t\r\n"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def slug_key(c: Column) -> Column:
    return F.lower(strip(c))


def idx_key(c: Column) -> Column:
    return F.upper(strip(c))


def tag_key(c: Column) -> Column:
    return F.translate(F.lower(strip(c)), " _", "--")


def tag_set(c: Column) -> Column:
    """Sorted distinct compared tags; null and empty lists are both ``[]``."""
    tags = F.transform(F.coalesce(c, F.array().cast("array<string>")), tag_key)
    return F.array_sort(F.array_distinct(F.filter(tags, lambda t: t.isNotNull() & (t != ""))))
