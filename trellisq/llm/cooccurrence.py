"""How often two items occur in the same basket, and how much more often than chance.

Method: large-basket blocking. Baskets up to ``block`` items give their pairs
in place; larger ones are cut into chunks of ``block`` items, which are spread
over the tasks, and each product of two chunks is joined by its own key, so no
task holds or writes the square of a huge basket. Counts are combined before
the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellisq.session import cut_lineage, look_up


def _within(items) -> "F.Column":
    """All (a, b), a < b, of one sorted array of distinct items."""
    firsts = F.transform(
        items, lambda a, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    return F.flatten(firsts)


def _between(left, right) -> "F.Column":
    """All (a, b) of two disjoint arrays, the lesser item first."""
    return F.flatten(F.transform(left, lambda x: F.transform(
        right, lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))))


def item_pairs(baskets: DataFrame, block: int = 128) -> DataFrame:
    """(a, b, n_ab): in how many baskets a and b, a < b, stand together.

    baskets: a column ``items`` with an array of items. A basket is a set:
    repeated and null items don't count, null and empty baskets and those of
    one item have no pair. Repeated rows are baskets of their own. No
    threshold or cap is applied.
    """
    sets = baskets.select(F.array_sort(F.array_distinct(F.array_compact("items"))).alias("items")).where(
        F.size("items") > 1)
    small = sets.where(F.size("items") <= block).select(F.explode(_within(F.col("items"))).alias("p"))
    # Spark may try the expression on baskets that the filter drops: it has to hold for these too.
    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size("items") / block).cast("int") - 1, F.lit(0))),
        lambda k: F.slice(F.col("items"), k * block + 1, block))
    # The chunks leave the basket's task before they are paired; the id has to be the same in both sides of the join.
    huge = cut_lineage(sets.where(F.size("items") > block).withColumn("basket", F.monotonically_increasing_id()))
    chunks = cut_lineage(huge.select("basket", F.posexplode(cut).alias("k", "x")).repartition("basket", "k"))
    last = chunks.groupBy("basket").agg(F.max("k").alias("last"))
    # Each chunk goes once to every product it is part of, so a product is a row that any task may expand.
    every = look_up(chunks, last, ["basket"]).select("basket", "k", "x", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("o"))
    left = every.where(F.col("k") <= F.col("o")).select("basket", F.col("k").alias("i"), F.col("o").alias("j"), "x")
    right = every.where(F.col("k") >= F.col("o")).select("basket", F.col("o").alias("i"), F.col("k").alias("j"), F.col("x").alias("y"))
    products = left.join(right, ["basket", "i", "j"])
    large = products.select(F.explode(
        F.when(F.col("i") == F.col("j"), _within(F.col("x"))).otherwise(_between(F.col("x"), F.col("y")))).alias("p"))
    return small.unionByName(large).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n_ab"))


def associations(baskets: DataFrame, one_in: int | None = None, min_lift: float = 0.0, block: int = 128) -> DataFrame:
    """Pairs with their counts and association scores.

    ``n`` is the number of baskets, empty and null ones included; ``lift`` is
    n_ab * n / (n_a * n_b), ``pmi`` its logarithm, ``npmi`` that divided by
    -ln(n_ab / n) (1 where every basket holds both), ``jaccard`` the share of
    the baskets with either item that hold both. Pairs that stand together in
    less than one of ``one_in`` baskets, or with lift < min_lift, are left out. An empty table gives no rows.
    """
    # Read three times below.
    baskets = cut_lineage(baskets.select("items"))
    total = baskets.select(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(baskets.select(F.explode(F.array_distinct(F.array_compact("items"))).alias("item")).groupBy("item").agg(
        F.count(F.lit(1)).alias("k")))
    pairs = item_pairs(baskets, block).crossJoin(F.broadcast(total))  # one row
    if one_in:
        pairs = pairs.where(F.col("n_ab") * F.lit(one_in) >= F.col("n"))
    # An item may stand in most of the pairs.
    pairs = cut_lineage(pairs)
    scored = look_up(look_up(pairs, counts.select(F.col("item").alias("a"), F.col("k").alias("n_a")), ["a"]),
                     counts.select(F.col("item").alias("b"), F.col("k").alias("n_b")), ["b"])
    lift = F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    rare = -F.log(F.col("n_ab") / F.col("n"))
    return scored.where(
        F.col("n_ab").cast("double") * F.col("n") >= F.lit(min_lift) * F.col("n_a").cast("double") * F.col("n_b")
    ).select(
        "a", "b", "n", "n_a", "n_b", "n_ab", lift.alias("lift"), F.log(lift).alias("pmi"),
        F.when(rare > 0, F.log(lift) / rare).otherwise(F.lit(1.0)).alias("npmi"),
        (F.col("n_ab") / (F.col("n_a") + F.col("n_b") - F.col("n_ab"))).alias("jaccard"),
    )
