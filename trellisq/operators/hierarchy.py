"""Parent-child links of unknown depth to labelled trees.

Method: pointer doubling yields subtree sizes in log2(depth) rounds and leaves
over the nodes that lie on or run into a circle. The child with the largest
subtree continues its parent's chain (heavy path), so any node meets at most
log2(n) chains on its way to the root. Everything else is read off the chains:
root and depth from the few chains above, paths by concatenating what each
chain above contributes, and descendants as one interval of places, since a
chain takes consecutive places in the order of a walk that enters the heavy
child first.

Links are followed by ``session.look_up``: finished nodes are not joined again,
and a node that many others point at is not gathered in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellisq.session import cut_round, look_up

#: The root of a node whose chain of parents never ends.
NO_ROOT = "-"
#: Hexadecimal digits of the name's digest by which siblings are ordered first: their places are summed in so many parts.
SIBLING_DIGITS = 3
#: Nodes of a chain that share one task when its names are put together.
CHAIN_BLOCK = 1024


def _parents(links: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """(node, parent) for every node; parent is null for a root."""
    pairs = links.select("parent", "child")
    rows = [pairs.select(F.col("child").alias("node"), "parent"), pairs.select(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent"))]
    if nodes is not None:
        rows.append(nodes.select("node", F.lit(None).cast("string").alias("parent")))
    return reduce(DataFrame.unionByName, rows).where(F.col("node").isNotNull()).groupBy("node").agg(F.min("parent").alias("parent"))


def _sizes(parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, parent, size) of the trees, and (node, parent, jump) of what has no root.

    After round k, ``jump`` is the 2^k-th ancestor and ``size`` the number of
    descendants (with the node) nearer than 2^k. A round joins live nodes only,
    those with such an ancestor; what they add to finished nodes is summed at
    the end. The number of live nodes falls in every round until only circular
    ones are left: a tree of depth >= 2^k has a node at a depth in [2^(k-1), 2^k).
    """
    one = F.lit(1).cast("bigint")
    finished = [parents.where(F.col("parent").isNull()).select("node", "parent", one.alias("size"))]
    gained = []
    live = parents.where(F.col("parent").isNotNull()).select("node", "parent", F.col("parent").alias("jump"), one.alias("size"))
    n = live.count()
    while n:
        added = live.groupBy(F.col("jump").alias("node")).agg(F.sum("size").alias("more"))
        ahead = live.select(F.col("node").alias("jump"), F.col("jump").alias("jump2"))
        stepped = cut_round(look_up(live, ahead, ["jump"], n).join(added, "node", "left").select(
            "node", "parent", F.col("jump2").alias("jump"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        gained.append(added.join(live.select("node"), "node", "left_anti").select("node", "more"))
        finished.append(stepped.where(F.col("jump").isNull()).select("node", "parent", "size"))
        live = stepped.where(F.col("jump").isNotNull())
        before, n = n, live.count()
        if n == before:
            break
    parts = [f.select("node", "parent", "size") for f in finished]
    parts += [g.select("node", F.lit(None).cast("string").alias("parent"), F.col("more").alias("size")) for g in gained]
    every = reduce(DataFrame.unionByName, parts).groupBy("node").agg(F.max("parent").alias("parent"), F.sum("size").alias("size"))
    if not n:
        return cut_round(every), live.select("node", "parent", "jump")
    # What circular nodes hand to each other says nothing about trees.
    return cut_round(every.join(live.select("node"), "node", "left_anti")), live.select("node", "parent", "jump")


def _chains(tree: DataFrame) -> DataFrame:
    """(node, parent, size, heavy, chain, pos): chain is the name of its head, pos the place on it from 0."""
    # Ties between equally large children go to the smaller name: order is by -size, then name.
    heavy = tree.where(F.col("parent").isNotNull()).groupBy("parent").agg(
        F.min(F.struct((-F.col("size")).alias("s"), "node")).alias("h")).select(F.col("h.node").alias("node"), F.lit(True).alias("heavy"))
    marked = cut_round(tree.join(heavy, "node", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False))))
    done = marked.where(~F.col("heavy")).select("node", F.col("node").alias("chain"), F.lit(0).cast("bigint").alias("pos"))
    live = marked.where("heavy").select("node", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("pos"))
    while live.limit(1).count():
        # No two nodes of a round have the same ``up``: a node has one heavy child.
        ahead = live.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.lit(None).cast("string").alias("chain"), F.col("pos").alias("pos2"))
        ahead = ahead.unionByName(done.select(F.col("node").alias("up"), F.lit(None).cast("string").alias("up2"), "chain", F.col("pos").alias("pos2")))
        stepped = cut_round(live.join(ahead, "up").select("node", F.col("up2").alias("up"), "chain", (F.col("pos") + F.col("pos2")).alias("pos")))
        done = done.unionByName(stepped.where(F.col("chain").isNotNull()).select("node", "chain", "pos"))
        live = stepped.where(F.col("chain").isNull()).select("node", "up", "pos")
    return marked.join(done, "node")


def _light_offsets(marked: DataFrame) -> DataFrame:
    """(chain, offset) of each light child: the places between its parent and it.

    A walk enters the heavy child first, then the light ones by the digest of
    their names, then by name. Sizes are summed over parts of the digests first,
    so the children of one node are never sorted in one task.
    """
    light = marked.where(~F.col("heavy") & F.col("parent").isNotNull()).select(
        "parent", "node", "size", F.md5("node").alias("digest")).withColumn("part", F.substring("digest", 1, SIBLING_DIGITS))
    first = marked.where("heavy").select("parent", F.col("size").alias("first"))
    parts = light.groupBy("parent", "part").agg(F.sum("size").alias("n"))
    earlier = parts.withColumn("earlier", F.sum("n").over(Window.partitionBy("parent").orderBy("part")) - F.col("n")).drop("n")
    # At most 16^SIBLING_DIGITS rows for a parent.
    earlier = earlier.join(first, "parent").withColumn("earlier", F.col("earlier") + F.col("first")).drop("first")
    within = F.sum("size").over(Window.partitionBy("parent", "part").orderBy("digest", "node")) - F.col("size")
    return light.withColumn("within", within).join(earlier, ["parent", "part"]).select(
        F.col("node").alias("chain"), (F.lit(1) + F.col("earlier") + F.col("within")).alias("offset"))


def _chain_tree(marked: DataFrame) -> DataFrame:
    """(chain, root, head_depth, start) of each chain, by doubling over the at most log2(n) chains above it.

    head_depth is the depth of its head, start the place of its head in the walk through its tree.
    """
    heads = marked.where(~F.col("heavy")).select(F.col("node").alias("chain"), F.col("parent").alias("above"))
    places = marked.select(F.col("node").alias("above"), F.col("chain").alias("up"), F.col("pos").alias("at"))
    hung = look_up(heads.where(F.col("above").isNotNull()), places, ["above"]).join(_light_offsets(marked), "chain")
    zero = F.lit(0).cast("bigint")
    nothing = F.lit(None).cast("string")
    done = heads.where(F.col("above").isNull()).select("chain", F.col("chain").alias("root"), zero.alias("head_depth"), zero.alias("start"))
    live = cut_round(hung.select(
        "chain", "up", (F.col("at") + 1).alias("head_depth"), (F.col("at") + F.col("offset")).alias("start")))
    while live.limit(1).count():
        far = [F.col("head_depth").alias("d2"), F.col("start").alias("s2")]
        ahead = live.select(F.col("chain").alias("up"), F.col("up").alias("up2"), nothing.alias("root"), *far).unionByName(
            done.select(F.col("chain").alias("up"), nothing.alias("up2"), "root", *far))
        stepped = cut_round(look_up(live, ahead, ["up"]).select(
            "chain", F.col("up2").alias("up"), "root", (F.col("head_depth") + F.col("d2")).alias("head_depth"),
            (F.col("start") + F.col("s2")).alias("start")))
        done = done.unionByName(stepped.where(F.col("root").isNotNull()).drop("up"))
        live = stepped.where(F.col("root").isNull()).drop("root")
    return done


def hierarchy(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Labels every node of the forest given by ``links`` (parent, child).

    ``nodes`` (node) adds nodes that have no link. Repeated links count once.
    A null child or parent makes no link, the other end stays a node; the
    empty string is a name like any other. Of several parents of a node the
    smallest name holds. A node on a circle (a link to itself included), or
    whose parents run into one, has root ``-``, depth -1 and null chain
    fields. Empty tables give no rows. Extra columns are not read.

    Returns node, parent, root, depth, size (descendants with the node),
    chain (its head), pos (place on the chain, from 0), head_depth and place
    (in the walk through the tree of ``root``, from 0).
    """
    tree, circular = _sizes(cut_round(_parents(links, nodes)))
    marked = cut_round(_chains(tree))
    chains = cut_round(_chain_tree(marked))
    labelled = look_up(marked, chains, ["chain"]).select(
        "node", "parent", "root", (F.col("head_depth") + F.col("pos")).alias("depth"), "size", "chain", "pos", "head_depth",
        (F.col("start") + F.col("pos")).alias("place"))
    none = F.lit(None).cast("bigint")
    return labelled.unionByName(circular.select(
        "node", "parent", F.lit(NO_ROOT).alias("root"), F.lit(-1).cast("bigint").alias("depth"), none.alias("size"),
        F.lit(None).cast("string").alias("chain"), none.alias("pos"), none.alias("head_depth"), none.alias("place")))


def descendants(labelled: DataFrame) -> DataFrame:
    """(node, root, place, first, last): the descendants of a node as an interval of places in the tree of ``root``.

    A walk that enters the heavy child first gives each chain consecutive
    places and each subtree one interval: the proper descendants of a node are
    the nodes of the same root with first <= place <= last. A leaf has null
    bounds, as have circular nodes, which have no descendants here. One row
    for each node, however many pairs that stands for; ``descendants_of``
    expands the interval of chosen nodes.
    """
    some = F.col("size") > 1
    return labelled.select(
        "node", "root", "place", F.when(some, F.col("place") + 1).alias("first"),
        F.when(some, F.col("place") + F.col("size") - 1).alias("last"))


def descendants_of(labelled: DataFrame, ancestors: DataFrame, max_ancestors: int = 1_000) -> DataFrame:
    """(ancestor, node, distance) of each node below one of ``ancestors`` (node), which are at most ``max_ancestors``.

    The chosen ancestors are broadcast; their descendants are found by root and place.
    """
    wanted = labelled.join(ancestors.select("node").distinct(), "node", "left_semi").where(F.col("size") > 1).select(
        "root", F.col("node").alias("ancestor"), F.col("place").alias("p"), F.col("size").alias("n"), F.col("depth").alias("d"))
    if wanted.limit(max_ancestors + 1).count() > max_ancestors:
        raise ValueError(f"more than {max_ancestors} ancestors: use the intervals of descendants()")
    inside = (F.col("place") > F.col("p")) & (F.col("place") < F.col("p") + F.col("n"))
    return labelled.join(F.broadcast(wanted), "root").where(inside).select(
        "ancestor", "node", (F.col("depth") - F.col("d")).alias("distance"))


def paths(labelled: DataFrame, separator: str = " > ") -> DataFrame:
    """(node, root, depth, path): names from the root down to the node.

    The names of a chain down to a place are put together once, in blocks of
    CHAIN_BLOCK nodes; a chain's path is that of the node it hangs on, level by
    level of the at most log2(n) chains above, and a node's path is that and
    its own chain's part. The path of a circular node is null.
    """
    labelled = cut_round(labelled)
    tree = labelled.where(F.col("chain").isNotNull()).withColumn("block", F.floor(F.col("pos") / CHAIN_BLOCK))
    blocks = tree.groupBy("chain", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("names")).select(
        "chain", "block", F.array_join(F.transform("names", lambda x: x["node"]), separator).alias("text"))
    above = Window.partitionBy("chain").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("chain", "block", F.collect_list("text").over(above).alias("before"))
    up_to = Window.partitionBy("chain", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = cut_round(tree.withColumn("names", F.collect_list("node").over(up_to)).join(blocks, ["chain", "block"]).select(
        "node", "parent", "chain", F.array_join(F.concat("before", "names"), separator).alias("own")))
    heads = own.where(F.col("node") == F.col("chain")).select("chain", F.col("parent").alias("above"))
    hung = cut_round(look_up(heads.where(F.col("above").isNotNull()), own.select(
        F.col("node").alias("above"), F.col("chain").alias("up"), F.col("own").alias("part")), ["above"]))
    level = heads.where(F.col("above").isNull()).select("chain", F.lit("").alias("prefix"))
    found = [level]
    while True:
        level = cut_round(look_up(hung, level.select(F.col("chain").alias("up"), "prefix"), ["up"]).where(
            F.col("prefix").isNotNull()).select("chain", F.concat("prefix", "part", F.lit(separator)).alias("prefix")))
        if not level.limit(1).count():
            break
        found.append(level)
    prefixes = reduce(DataFrame.unionByName, found)
    path = look_up(own, prefixes, ["chain"]).select("node", F.concat("prefix", "own").alias("path"))
    return labelled.select("node", "root", "depth").join(path, "node", "left")


def circles(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, parent, circle, on_circle) of every node without a root; links and nodes as for ``hierarchy``.

    ``circle`` is the smallest name on the circle that the node lies on or runs
    into. The nodes on circles are those that a number of steps beyond any tail
    ends on; that number is doubled until they get no fewer.
    """
    lost = _sizes(cut_round(_parents(links, nodes)))[1].select("node", "parent", F.col("parent").alias("jump"))
    state = cut_round(lost)
    size = None
    while True:
        reached = cut_round(state.select(F.col("jump").alias("node")).distinct())
        n = reached.count()
        if n == size:
            break
        size = n
        state = cut_round(look_up(state, state.select(F.col("node").alias("jump"), F.col("jump").alias("jump2")), ["jump"]).select(
            "node", "parent", F.col("jump2").alias("jump")))
    low = cut_round(lost.join(reached, "node", "left_semi").select("node", F.col("parent").alias("next"), F.col("node").alias("low")))
    while True:
        ahead = low.select(F.col("node").alias("next"), F.col("next").alias("next2"), F.col("low").alias("low2"))
        stepped = cut_round(low.join(ahead, "next").select(
            "node", F.col("next2").alias("next"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved")))
        low = stepped.drop("moved")
        if not stepped.where("moved").limit(1).count():
            break
    ends = look_up(state, low.select(F.col("node").alias("jump"), F.col("low").alias("circle")), ["jump"])
    return ends.join(reached.withColumn("on_circle", F.lit(True)), "node", "left").select(
        "node", "parent", "circle", F.coalesce("on_circle", F.lit(False)).alias("on_circle"))
