"""Error-rate baseline per service over a stream, and the state table of the detector's."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DetectSettings
from ..session import remove
from .refold import refold_batch

DEFAULTS = DetectSettings()
STATE = "service string, last_bucket timestamp, ewma double"
LATE = "service string, late_readings bigint, batch int"


def state_place(state_path: str, batch_id: int) -> str:
    return f"{state_path}/before={batch_id}"


def read_state(spark: SparkSession, state_path: str, batch_id: int) -> DataFrame:
    """The state before a batch. Only the first batch may find none; a lost folder is an
    error, as every service would silently start anew."""
    try:
        return spark.read.schema(STATE).parquet(state_place(state_path, batch_id))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        if batch_id:
            raise RuntimeError(f"the state before batch {batch_id} is missing: {state_path}") from e
        return spark.createDataFrame([], STATE)


def write_state(state: DataFrame, after: DataFrame, state_path: str, batch_id: int) -> None:
    """The state that the batch behind this one starts from; services without news keep theirs."""
    untouched = state.join(after.select("service"), "service", "left_anti")
    untouched.unionByName(after).write.mode("overwrite").parquet(
        state_place(state_path, batch_id + 1)
    )
    # This batch may be repeated and needs its own state; the one before it is done with.
    remove(state.sparkSession, state_place(state_path, batch_id - 1))


def with_lateness(buckets: DataFrame, state: DataFrame) -> DataFrame:
    """Adds ``late``: whether the service's baseline has moved past the bucket already."""
    last = state.select("service", "last_bucket")
    late = F.coalesce(F.col("bucket") <= F.col("last_bucket"), F.lit(False))
    return buckets.join(last, "service", "left").withColumn("late", late).drop("last_bucket")


def report_late(readings: DataFrame, state_path: str, batch_id: int) -> None:
    """Counts the readings of a batch that came too late to be folded, per service."""
    readings.groupBy("service").agg(F.count("*").alias("late_readings")).write.mode(
        "overwrite"
    ).parquet(f"{state_path}/late/batch={batch_id}")


def late_readings(spark: SparkSession, state_path: str) -> DataFrame:
    """Readings per service and batch that were not folded: those that came after a newer one
    of their service, and those delivered again."""
    return spark.read.schema(LATE).parquet(f"{state_path}/late")


def baseline_batch(
    readings: DataFrame, batch_id: int, state_path: str, out_path: str,
    settings: DetectSettings = DEFAULTS,
) -> None:
    """Folds a batch of (service, bucket, rate) and writes the baseline each reading met.

    Readings may come in any order and late: ``refold_batch`` writes a new version of every
    baseline that they move, and ``refold.current_baselines`` reads the last ones.
    """
    refold_batch(readings, batch_id, state_path, out_path, settings)


def start_error_baselines(
    readings: DataFrame, state_path: str, out_path: str, checkpoint: str,
    settings: DetectSettings = DEFAULTS, poll_s: int = 15, available_now: bool = False,
) -> StreamingQuery:
    """Starts the fold over a stream of readings of closed buckets."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        baseline_batch(batch, batch_id, state_path, out_path, settings)

    writer = readings.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{poll_s} seconds").start()
