"""Live counterparts of the polling features.

Every job reads files as a stream, reduces each batch to rows that merge (a
set, a minimum) and writes them as one folder per batch in the shared folder;
the reader merges the folders. So no state grows in the executors, nothing is
too late to count, and a batch that is repeated after a failure overwrites its
own folder: results are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellisq.functions.normalize import idx_key
from trellisq.session import scratch_path


def file_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table's files as a stream, whether it is one file or a folder of them."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def run_available(stream: DataFrame, reduced: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs the stream over what is there now; returns the reduced rows of all batches, still to be merged."""
    spark = stream.sparkSession
    home = scratch_path(spark, "stream")

    def write(batch: DataFrame, batch_id: int) -> None:
        reduced(batch).write.mode("overwrite").parquet(f"{home}/out/batch={batch_id}")

    run = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    empty = reduced(spark.createDataFrame([], stream.schema))
    return spark.read.schema(empty.schema).parquet(f"{home}/out") if run.lastProgress else empty


def submission_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_stream(spark, sf_dir, "submissions").select(
        "submission_id", "user_id", "contest_id", idx_key(F.col("idx")).alias("idx"), F.col("verdict").eqNullSafe("OK").alias("ok"),
        F.col("submitted_at").cast("timestamp").alias("at"))


def daily_activity(submissions: DataFrame) -> DataFrame:
    """(user_id, date, attempted, solved) per day; a submission that is delivered twice counts once, however late."""
    rows = run_available(submissions, lambda b: b.select("submission_id", "user_id", F.to_date("at").alias("date"), "ok").distinct())
    return rows.select("submission_id", "user_id", "date", "ok").distinct().groupBy("user_id", "date").agg(F.count(F.lit(1)).alias("attempted"), F.count_if("ok").alias("solved"))


def contest_solved(submissions: DataFrame, problems: DataFrame) -> DataFrame:
    """(user_id, contest_id, idx): each problem of the static set once, when a first success arrives."""
    keys = problems.select("contest_id", "idx")
    hits = lambda b: b.where("ok").join(keys, ["contest_id", "idx"], "left_semi").select("user_id", "contest_id", "idx").distinct()
    return run_available(submissions, hits).select("user_id", "contest_id", "idx").distinct()


def first_seen(submissions: DataFrame) -> DataFrame:
    """(user_id, contest_id, idx, date): the earliest day on which a problem was seen solved."""
    earliest = lambda b, day: b.groupBy("user_id", "contest_id", "idx").agg(F.min(day).alias("date"))
    return earliest(run_available(submissions, lambda b: earliest(b.where("ok"), F.to_date("at"))), "date")


def session_phase(started: Column, now: Column, seconds: int, warning: int = 300, critical: int = 60) -> Column:
    """idle, running, warning, critical or expired: where a contest of that many seconds stands; polling ends at expired."""
    left = F.lit(seconds) - (F.unix_timestamp(now) - F.unix_timestamp(started))
    return (
        F.when(started.isNull(), "idle").when(left <= 0, "expired").when(left <= critical, "critical")
        .when(left <= warning, "warning").otherwise("running"))
