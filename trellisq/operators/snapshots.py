"""What changed between consecutive full snapshots of a keyed table.

Method: the snapshots are key-sorted and cut into content-defined chunks (a
row whose key hash falls on a fixed residue opens a chunk, so an insertion
moves only its own chunk), coarse ones and fine ones inside them. Coarse chunks
with equal digests in both snapshots are discarded, then equal fine chunks of
the others; only rows of the rest are joined and classified. Behind the scan a
row is its key and a digest of its values: wide rows are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellisq.session import broadcast_if_small, cut_lineage
from trellisq.sources.tables import latest_by


#: More snapshots than this are joined by a shuffle.
MAX_BROADCAST_STEPS = 10_000


def _tag_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds the coarse and the fine chunk of each row; rows come sorted by snapshot and key.

    A chunk is named by the hash of the key that opens it, or by the partition
    before its first opening key; all snapshots share the partitions.
    """
    part = TaskContext.get().partitionId()
    snap, last = None, {}
    for b in batches:
        if b.empty:
            continue
        s = b["snap"].to_numpy()
        new = np.concatenate(([snap is None or s[0] != snap], s[1:] != s[:-1]))
        for level in ("coarse", "fine"):
            opens = b[f"opens_{level}"].to_numpy()
            names = np.where(opens, b["key_hash"].to_numpy(), -1 - part)
            at = np.maximum.accumulate(np.where(opens | new, np.arange(len(b)), -1))
            b[level] = np.where(at >= 0, names[np.maximum(at, 0)], last.get(level, 0))
            last[level] = int(b[level].iloc[-1])
        snap = s[-1]
        yield b.drop(columns=["opens_coarse", "opens_fine", "key_hash"])


def _differing(digests: DataFrame, steps: DataFrame, chunk: list[str]) -> DataFrame:
    """(chunk, later) of the chunks whose digest differs between the snapshots of a step, or that one of them lacks."""
    names = ["n", "d1", "d2"]
    a = digests.join(steps, "snap").select(*chunk, "later", *[F.col(x).alias(f"{x}_a") for x in names])
    b = digests.join(F.broadcast(steps.select(F.col("later").alias("snap"))), "snap").select(*chunk, F.col("snap").alias("later"), *names)
    same = F.lit(True)
    for x in names:
        same = same & F.col(x).eqNullSafe(F.col(f"{x}_a"))
    return a.join(b, [*chunk, "later"], "full_outer").where(~same).select(*chunk, "later")


def chunked_rows(
    rows: DataFrame, snapshot: str, keys: list[str], version: str, values: dict[str, Column], coarse_rows: int = 64, fine_rows: int = 4,
) -> DataFrame:
    """(snap, keys, digest, coarse, fine): the row that holds for each key of each snapshot, with its chunks."""
    value = F.struct(*[c.alias(f"_v_{n}") for n, c in values.items()])
    # Nulls are values of their own: to_json leaves them out, which no other value does.
    flat = rows.select(
        F.col(snapshot).alias("snap"), *[F.col(k) for k in keys], F.col(version).alias("_version"),
        F.unhex(F.md5(F.to_json(value).cast("binary"))).alias("digest"),
    ).where(F.col("snap").isNotNull())
    held = latest_by(flat, ["snap", *keys], "_version", ["digest"])
    key_hash = F.shiftrightunsigned(F.xxhash64(*keys, *[F.col(k).isNull() for k in keys]), 1)
    keyed = held.withColumn("key_hash", key_hash).withColumns({
        "opens_coarse": F.pmod("key_hash", F.lit(coarse_rows * fine_rows)) < fine_rows,
        "opens_fine": (F.pmod("key_hash", F.lit(fine_rows)) == 0) | (F.pmod("key_hash", F.lit(coarse_rows * fine_rows)) < fine_rows),
    })
    # One range partitioning for all snapshots: a key range lies in one task whatever the snapshot.
    placed = keyed.repartitionByRange(*keys).sortWithinPartitions("snap", *keys)
    gone = ("opens_coarse", "opens_fine", "key_hash")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields if f.name not in gone)
    return cut_lineage(placed.mapInPandas(_tag_chunks, schema + ", coarse bigint, fine bigint"))


def suspect_rows(tagged: DataFrame, keys: list[str]) -> DataFrame:
    """(later, old, keys, digest) of the rows whose fine chunk differs between the snapshots of a step."""
    ids = tagged.select("snap").distinct()
    steps = broadcast_if_small(
        ids.withColumn("later", F.lead("snap").over(Window.orderBy("snap"))).where(F.col("later").isNotNull()),
        MAX_BROADCAST_STEPS)
    wide = "decimal(38,0)"
    row = F.xxhash64(*keys, *[F.col(k).isNull() for k in keys], "digest")
    other = F.xxhash64(F.lit(7919), "digest", *keys, *[F.col(k).isNull() for k in keys])
    # Rows are combined map-side: a chunk's rows lie in one task. Coarse digests are sums of the fine ones.
    fine = cut_lineage(tagged.groupBy("coarse", "fine", "snap").agg(
        F.count(F.lit(1)).alias("n"), F.sum(row.cast(wide)).alias("d1"), F.bit_xor(other).alias("d2")))
    coarse = fine.groupBy("coarse", "snap").agg(F.sum("n").alias("n"), F.sum("d1").alias("d1"), F.bit_xor("d2").alias("d2"))
    open_chunks = _differing(coarse, steps, ["coarse"])
    roles = steps.select("snap", "later", F.lit(True).alias("old")).unionByName(
        steps.select(F.col("later").alias("snap"), "later", F.lit(False).alias("old")))
    roles = broadcast_if_small(roles, 2 * MAX_BROADCAST_STEPS)
    # A fine chunk is asked about only where its coarse chunk differs in that step.
    parts = fine.join(roles, "snap").join(open_chunks, ["coarse", "later"], "left_semi")
    a = parts.where("old").select("coarse", "fine", "later", *[F.col(x).alias(f"{x}_a") for x in ("n", "d1", "d2")])
    b = parts.where(~F.col("old")).select("coarse", "fine", "later", "n", "d1", "d2")
    same = F.col("n").eqNullSafe(F.col("n_a")) & F.col("d1").eqNullSafe(F.col("d1_a")) & F.col("d2").eqNullSafe(F.col("d2_a"))
    left_over = a.join(b, ["coarse", "fine", "later"], "full_outer").where(~same).select("coarse", "fine", "later")
    return tagged.join(roles, "snap").join(left_over, ["coarse", "fine", "later"], "left_semi").select("later", "old", *keys, "digest")


def snapshot_changes(
    rows: DataFrame,
    snapshot: str,
    keys: list[str],
    version: str,
    values: dict[str, Column],
    mean_chunk_rows: int = 64,
    fine_chunk_rows: int = 4,
) -> DataFrame:
    """Rows added, removed or changed from each snapshot to the next.

    rows: full deliveries; ``values`` names the compared columns, null being a
    value of its own. Values compare by a 128-bit digest. Of several rows for
    (snapshot, key) the one with the greatest ``version`` holds (null is
    oldest; ties: the greatest digest), so repeated rows and ties have one
    result. Rows whose snapshot is null are ignored; a null in a key is a key
    value like any other. Snapshots are consecutive in the order of their ids,
    whatever the gaps. A snapshot that has no row at all cannot be seen; an
    empty table or a single snapshot gives no rows. Extra columns are not read.

    Returns ``snapshot_id`` (the later one), the keys, ``change`` (added,
    removed, changed).
    """
    tagged = chunked_rows(rows, snapshot, keys, version, values, mean_chunk_rows, fine_chunk_rows)
    # A key is in at most one old and one new row of a step.
    paired = suspect_rows(tagged, keys).groupBy("later", *keys).agg(
        F.max(F.when(F.col("old"), F.col("digest"))).alias("was"), F.max(F.when(~F.col("old"), F.col("digest"))).alias("now"))
    change = (
        F.when(F.col("was").isNull(), "added")
        .when(F.col("now").isNull(), "removed")
        .when(F.col("was") != F.col("now"), "changed"))
    return paired.select(F.col("later").alias("snapshot_id"), *keys, change.alias("change")).where(F.col("change").isNotNull())


def discard_report(rows: DataFrame, snapshot: str, keys: list[str], version: str, values: dict[str, Column], **chunks: int) -> DataFrame:
    """(n_rows, n_suspect, discarded_share): of the rows that take part in a step, how many equal digests rule out."""
    tagged = chunked_rows(rows, snapshot, keys, version, values, **chunks)
    edges = tagged.agg(F.min("snap").alias("a"), F.max("snap").alias("b"))  # one row
    part = F.when(F.col("a") == F.col("b"), 0).when((F.col("snap") == F.col("a")) | (F.col("snap") == F.col("b")), 1).otherwise(2)
    n = tagged.crossJoin(F.broadcast(edges)).agg(F.coalesce(F.sum(part), F.lit(0)).alias("n_rows"))
    left = suspect_rows(tagged, keys).agg(F.count(F.lit(1)).alias("n_suspect"))
    return n.crossJoin(F.broadcast(left)).select(
        "n_rows", "n_suspect", F.try_divide(F.col("n_rows") - F.col("n_suspect"), F.col("n_rows")).alias("discarded_share"))
