"""Session helpers: cutting lineage, size-checked broadcasts, joins on skewed keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of up to so many rows are broadcast by ``look_up``.
SMALL_ROWS = 200_000
#: A key is hot if it holds more than one in so many rows, so at most so many keys are hot.
HOT_ONE_IN = 100_000

_written: dict[str, SparkSession] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables and stream state.

    The cluster names it in ``spark.checkpoint.dir``. A folder of our own is
    made only where that is unset and the session is a local one.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="trellisq-checkpoints-")
        _written[named] = spark
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
        _written[sc.getCheckpointDir()] = spark
    return named


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; ``clean_up`` removes what lies there."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trellisq-{kind}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialises ``df`` reliably: the files outlive any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_round(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for loops.

    A checkpoint keeps the optimizer's estimates, and a join multiplies those
    of its sides: in a loop of self-joins their digits double in every round.
    Here the estimates are dropped as well.
    """
    kept, spark = cut_lineage(df)._jdf, df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(kept.toJavaRDD(), kept.schema()), spark)


def stored_blocks(df: DataFrame, by: list[str], n_blocks: int, kind: str) -> str:
    """Writes ``df`` in blocks by the hash of ``by`` into the shared folder, where any task may read one with ``read_block``."""
    path = scratch_path(df.sparkSession, kind)
    block = F.pmod(F.xxhash64(*by), F.lit(n_blocks))
    df.withColumn("_block", block).repartition(n_blocks, "_block").write.partitionBy("_block").parquet(path)
    p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def read_block(path: str, block: int):
    """One block as an Arrow table, or None if it is empty; runs on the executors."""
    from pyarrow import dataset, fs

    if path.startswith("file:"):
        system, root = fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    else:
        system, root = fs.FileSystem.from_uri(path)
    place = f"{root}/_block={block}"
    if system.get_file_info(place).type == fs.FileType.NotFound:
        return None
    return dataset.dataset(place, filesystem=system, format="parquet").to_table()


def clean_up() -> None:
    """Removes the intermediate files that this process has written; results must have been read by then.

    A checkpoint folder that someone else has set is theirs to remove.
    """
    for path, spark in list(_written.items()):
        try:
            jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the session may have ended before
            continue
        finally:
            _written.pop(path, None)


atexit.register(clean_up)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows.

    The count reads at most ``max_rows + 1`` rows. Beyond the bound the frame
    is returned as it is and Spark shuffles it.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def look_up(
    rows: DataFrame, table: DataFrame, on: list[str], n_table: int | None = None, small_rows: int = SMALL_ROWS,
    hot_one_in: int = HOT_ONE_IN, least_hot: int = 10_000,
) -> DataFrame:
    """``rows`` left-joined with ``table``, which has one row per key, however skewed the keys of ``rows`` are.

    A table of up to ``small_rows`` rows is broadcast. Otherwise the rows of
    hot keys (more than ``least_hot`` and more than one in ``hot_one_in`` of
    the rows, so at most ``hot_one_in`` keys) meet a broadcast of their part of
    the table, the others are shuffled, and rows with a null in the key, which
    match nothing, are joined to nothing. ``n_table`` saves counting the table.
    Both frames are read more than once:
    they should be stored tables or cheap to compute.
    """
    if (table.limit(small_rows + 1).count() if n_table is None else n_table) <= small_rows:
        return rows.join(F.broadcast(table), on, "left")
    added = [f for f in table.schema.fields if f.name not in on]
    whole = F.lit(True)
    for k in on:
        whole = whole & F.col(k).isNotNull()
    keyed = rows.where(whole)
    order = [*on, *[c for c in rows.columns if c not in on], *[f.name for f in added]]
    loose = rows.where(~whole).withColumns({f.name: F.lit(None).cast(f.dataType) for f in added}).select(*order)
    total = rows.count()
    counts = keyed.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    hot = cut_lineage(counts.where(F.col("_n") > max(least_hot, total // hot_one_in)).select(*on))
    cold = keyed.join(F.broadcast(hot), on, "left_anti").join(table, on, "left").select(*order)
    warm = keyed.join(F.broadcast(hot), on, "left_semi").join(
        F.broadcast(table.join(F.broadcast(hot), on, "left_semi")), on, "left").select(*order)
    return cold.unionByName(warm).unionByName(loose)
