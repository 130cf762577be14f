"""The rollup table, kept up to date from a stream or by periodic refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import RollupSettings
from ..functions.times import ORIGIN_S, bucket_start
from ..operators.rollup import error_count, refresh_bounds, rollup, rollup_counts
from ..schemas import ROLLUP
from ..sources.tables import EVENTS_TABLE, ROLLUP_TABLE

DEFAULTS = RollupSettings()


def latency_counts(events: DataFrame, width_s: int, delay_s: int) -> DataFrame:
    """Closed buckets as (bucket, service, latency_ms, n, errors).

    State is one row per distinct latency of an open bucket, spread over all
    state partitions, so a busy service is never one state row. A bucket comes
    out once, when the watermark has passed its end.
    """
    bucket = F.window("ts", f"{width_s} seconds", startTime=f"{ORIGIN_S % width_s} seconds")
    return (
        events.withWatermark("ts", f"{delay_s} seconds")
        .groupBy(bucket.alias("w"), "service", "latency_ms")
        .agg(F.count("*").alias("n"), error_count().alias("errors"))
        .select(F.col("w.start").alias("bucket"), "service", "latency_ms", "n", "errors")
    )


def start_rollup(
    events: DataFrame, rollup_path: str, checkpoint: str,
    settings: RollupSettings = DEFAULTS, available_now: bool = False,
) -> StreamingQuery:
    """Adds every closed bucket to the rollup table, once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # Evaluated once: running the batch again would update the state again.
        counts = batch.persist()
        try:
            # Most batches close no bucket.
            if counts.count():
                buckets = rollup_counts(counts, settings.hot_rows).persist()
                ROLLUP_TABLE.insert_new(buckets, rollup_path, ["event_count"])
                buckets.unpersist()
        finally:
            counts.unpersist()

    counts = latency_counts(events, settings.width_s, settings.refresh_start_s)
    writer = counts.writeStream.outputMode("append").foreachBatch(write).option(
        "checkpointLocation", checkpoint
    )
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{settings.refresh_end_s} seconds").start()


def refresh_table(
    spark: SparkSession, events_path: str, rollup_path: str, as_of,
    settings: RollupSettings = DEFAULTS,
) -> None:
    """Recomputes the closed buckets of the refresh range from the event table.

    Reads only the dates of the range. Older buckets keep their values, also
    when late rows have reached the event table since.
    """
    first, last = refresh_bounds(
        as_of, settings.width_s, settings.refresh_start_s, settings.refresh_end_s
    )
    backfill(spark, events_path, rollup_path, first, last, settings)


def backfill(
    spark: SparkSession, events_path: str, rollup_path: str, start, end,
    settings: RollupSettings = DEFAULTS,
) -> None:
    """Recomputes all buckets that [start, end) touches, for example to take in late rows.

    Bounds inside a bucket are widened to its edges, as a bucket is replaced as a whole.
    """
    begin, until = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    begin, last = bucket_start(begin, settings.width_s), bucket_start(until, settings.width_s)
    after = F.timestamp_seconds(F.unix_seconds(last) + settings.width_s)
    until = F.when(last == until, until).otherwise(after)
    ts, day = F.col("ts"), F.col(EVENTS_TABLE.partition)
    events = EVENTS_TABLE.read(spark, events_path).filter(
        (ts >= begin) & (ts < until) & (day >= F.to_date(begin)) & (day <= F.to_date(until))
    )
    fresh = rollup(events, settings.width_s, settings.hot_rows).select(*ROLLUP.fieldNames())
    # Used for the touched dates, the key join and the write.
    fresh = fresh.persist()
    try:
        ROLLUP_TABLE.replace(fresh, rollup_path)
    finally:
        fresh.unpersist()
