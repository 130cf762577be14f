"""Counters of the running pipeline as metric samples, for the panels.

Every batch writes what it adds to each counter, in a folder of its own, so a repeated batch
counts once. ``samples`` turns the increments into counters over time.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import IngestSettings
from ..plans.panels import SERIES, with_series
from ..schemas import METRIC_SAMPLES

RECORDS = "metric string, labels map<string,string>, ts timestamp, batch bigint, value double, gauge boolean"
NAMES = ["metric", "labels", "ts", "batch", "value", "gauge"]
Entry = tuple[str, dict[str, str], float]


def stream_id(spark: SparkSession) -> str:
    """Id that a streaming query keeps over restarts; 'batch' outside one."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"


def observed_once(metric: str, value: float, bounds: list[float]) -> list[Entry]:
    """What one observation adds to a cumulative histogram."""
    labels = [(f"{b:g}", value <= b) for b in bounds] + [("+Inf", True)]
    return [*((f"{metric}_bucket", {"le": le}, float(under)) for le, under in labels),
            (f"{metric}_sum", {}, float(value)), (f"{metric}_count", {}, 1.0)]


def grouped(counts: DataFrame, metric: str, labels: list[str], count: str) -> DataFrame:
    """Increments of a counter with one series per row of ``counts``."""
    pairs = [part for n in labels for part in (F.lit(n), F.col(n))]
    return counts.select(
        F.lit(metric).alias("metric"), F.create_map(*pairs).alias("labels"), F.col(count).cast("double").alias("value")
    )


def record(
    spark: SparkSession, path: str, source: str, batch_id: int, entries: list[Entry],
    frames: list[DataFrame] = [], gauges: list[Entry] = [], when: datetime | None = None,
) -> None:
    """Writes what a batch adds; ``frames`` are results of ``grouped``."""
    rows = [(*e, gauge) for part, gauge in ((entries, False), (gauges, True)) for e in part]
    added = spark.createDataFrame(rows, "metric string, labels map<string,string>, value double, gauge boolean")
    for frame in frames:
        added = added.unionByName(frame.withColumn("gauge", F.lit(False)))
    clock = F.lit(when or datetime.now(timezone.utc)).cast("timestamp")
    added.withColumns({"ts": clock, "batch": F.lit(batch_id).cast("long")}).select(*NAMES).coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{path}/source={source}/run={stream_id(spark)}/part={batch_id}")


def samples(spark: SparkSession, path: str) -> DataFrame:
    """All records as metric samples: counters run up over time, gauges stay as they are.

    Totals of earlier days are added to the running sum within a day, so that a series of
    many batches is not one sorted group.
    """
    try:
        rows = spark.read.schema(RECORDS).parquet(f"{path}/*/*/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], METRIC_SAMPLES)
    keyed = with_series(rows).withColumn("_day", F.to_date("ts"))
    series = ["metric", SERIES]
    within = Window.partitionBy(*series, "_day").orderBy("ts", "batch").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*series).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = keyed.groupBy(*series, "_day").agg(F.sum("value").alias("_sum"))
    days = days.select(*series, "_day", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_before"))
    total = F.when(F.col("gauge"), F.col("value")).otherwise(F.sum("value").over(within) + F.col("_before"))
    return keyed.join(days, [*series, "_day"]).withColumn("value", total).select(*METRIC_SAMPLES.fieldNames())


def messages_per_trigger(spark: SparkSession, path: str, settings: IngestSettings = IngestSettings()) -> int:
    """Messages that a micro-batch may have to be written in ``flush_target_s``.

    The speed is events written per second of flushing over the newest ``paced_by`` batches. Small
    batches look slow for their fixed costs, so the limit grows from one start to the next as long as
    batches take less than the target. Without measurements it is ``max_per_trigger``, which it never passes,
    and it is never below ``batch_size``.
    """
    try:
        rows = spark.read.schema(RECORDS).parquet(f"{path}/source=ingest/*/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return settings.max_per_trigger
    size, seconds = (F.col("metric") == f"ingestion_batch_{m}_sum" for m in ("size", "flush_duration_seconds"))
    batches = rows.filter(size | seconds).groupBy("ts", "batch").agg(
        F.sum(F.when(size, F.col("value"))).alias("size"), F.sum(F.when(seconds, F.col("value"))).alias("seconds")
    )
    seen = batches.orderBy(F.desc("ts"), F.desc("batch")).limit(settings.paced_by).agg(
        F.sum("size").alias("size"), F.sum("seconds").alias("seconds")).first()
    if not seen.seconds:
        return settings.max_per_trigger
    return int(min(max(seen.size / seen.seconds * settings.flush_target_s, settings.batch_size), settings.max_per_trigger))
