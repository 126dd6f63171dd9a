"""Rating ladders, the contest classifier and other label expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds of the rating classes of the three views, and the class above the last bound.
HEAT_LADDER = [(1200, "newbie"), (1400, "pupil"), (1600, "specialist"), (1900, "expert"), (2100, "cm"), (2300, "master")]
HEAT_TOP = "gm"
LIST_LADDER = [*HEAT_LADDER, (2600, "gm")]
LIST_TOP = "lgm"
PRACTICE_LADDER = [*HEAT_LADDER, (2400, "im"), (2600, "gm")]
PRACTICE_TOP = "lgm"
# What a contest's name holds, in the order in which it is asked.
CONTEST_CLASSES = [
    ("Combined", ("div. 1 + div. 2", "div. 1 and div. 2", "div. 1+2", "div 1 + div 2")),
    ("Div. 1", ("div. 1",)), ("Div. 2", ("div. 2",)), ("Div. 3", ("div. 3",)), ("Div. 4", ("div. 4",)),
    ("Educational", ("educational",)), ("Global Round", ("global",)),
]


def ladder(rating: Column, steps: list[tuple[int, str]], top: str) -> Column:
    first, *rest = steps
    chain = F.when(rating < first[0], first[1])
    for bound, name in rest:
        chain = chain.when(rating < bound, name)
    return chain.otherwise(top)


def heat_class(rating: Column) -> Column:
    return ladder(F.coalesce(rating, F.lit(0)), HEAT_LADDER, HEAT_TOP)


def list_class(rating: Column) -> Column:
    """Empty for an unrated problem."""
    return F.when(F.coalesce(rating, F.lit(0)) == 0, "").otherwise(ladder(rating, LIST_LADDER, LIST_TOP))


def practice_class(rating: Column) -> Column:
    return ladder(F.coalesce(rating, F.lit(0)), PRACTICE_LADDER, PRACTICE_TOP)


def contest_class(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    anyone = lambda words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    (first, words), *rest = CONTEST_CLASSES
    chain = F.when(anyone(words), first)
    for label, words in rest:
        chain = chain.when(anyone(words), label)
    return chain.otherwise("Other")


def series(contest_id: Column) -> Column:
    """The series of a contest by the prefix of its id."""
    low = F.coalesce(contest_id, F.lit(""))
    return F.when(low.startswith("abc"), "ABC").when(low.startswith("arc"), "ARC").when(low.startswith("agc"), "AGC").otherwise("Other")


def natural_key(idx: Column) -> Column:
    """Sorts single characters first, then by the first number, then other texts."""
    number = F.regexp_extract(idx, r"\d+", 0)
    return (
        F.when(F.length(idx) == 1, F.struct(F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("n"), idx.alias("t")))
        .when(number != "", F.struct(F.lit(1).alias("k"), F.try_to_number(number, F.lit("9" * 18)).cast("bigint").alias("n"), F.lit("").alias("t")))
        .otherwise(F.struct(F.lit(2).alias("k"), F.lit(0).cast("bigint").alias("n"), idx.alias("t")))
    )


def clock(seconds: Column) -> Column:
    """hh:mm:ss; hours may have more than two digits."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    hours = F.when(h < 10, F.concat(F.lit("0"), h.cast("string"))).otherwise(h.cast("string"))
    return F.concat_ws(":", hours, F.lpad(m.cast("string"), 2, "0"), F.lpad(s.cast("string"), 2, "0"))


def slugified(category: Column) -> Column:
    return F.replace(F.replace(F.lower(category), F.lit(" "), F.lit("_")), F.lit("&"), F.lit("and"))


def escaped(text: Column) -> Column:
    """HTML escape."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
