"""Messages to the event table, continuously.

Delivery: the checkpoint moves after a batch is written, and the write is a
keyed insert, so a batch that failed half-way is repeated without duplicates.
Nothing is dropped for being late.
"""

from __future__ import annotations

import time
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import IngestSettings
from ..operators.decode import BAD_JSON, accepted, classify, quarantined
from ..operators.metrics import BATCH_SIZE_BOUNDS, FLUSH_SECONDS_BOUNDS
from ..sources.tables import insert_events
from .counters import grouped, observed_once, record, stream_id

DEFAULTS = IngestSettings()
# Columns that tell arrival order, as far as a source has them.
ARRIVAL = ["timestamp", "partition", "offset"]


def observed(classified: DataFrame, name: str = "ingest") -> tuple[DataFrame, Observation]:
    """Counts taken while the rows pass: read, accepted and turned away."""
    rejected = F.col("reject_reason").isNotNull()
    watch = Observation(name)
    counted = classified.observe(
        watch,
        F.count("*").alias("consumed"),
        F.count_if(~rejected).alias("accepted"),
        F.count_if(rejected).alias("rejected"),
    )
    return counted, watch


def count_batch(
    classified: DataFrame, counts: dict[str, int], seconds: float, batch_id: int, path: str,
    when: datetime | None = None,
) -> None:
    """Records a written batch: events read per service and written, its size and its time."""
    decoded = classified.filter(F.coalesce(F.col("reject_reason") != BAD_JSON, F.lit(True)))
    services = decoded.groupBy("service").agg(F.count("*").alias("n"))
    entries = [
        ("ingestion_events_written_total", {}, float(counts["accepted"])),
        *observed_once("ingestion_batch_size", counts["accepted"], BATCH_SIZE_BOUNDS),
        *observed_once("ingestion_batch_flush_duration_seconds", seconds, FLUSH_SECONDS_BOUNDS),
    ]
    consumed = grouped(services, "ingestion_events_consumed_total", ["service"], "n")
    record(classified.sparkSession, path, "ingest", batch_id, entries, [consumed], when=when)


def ingest_batch(
    messages: DataFrame, batch_id: int, events_path: str, quarantine_path: str,
    counters_path: str | None = None, when: datetime | None = None,
) -> dict[str, int]:
    """Writes one batch of messages; safe to repeat. Returns the counts.

    With ``counters_path`` the batch is counted there, stamped ``when`` or the present moment; a
    batch whose write fails counts as a write error.
    """
    began = time.monotonic()
    spark = messages.sparkSession
    names = [n for n in ARRIVAL if n in messages.columns]
    order = [f"_{n}" for n in names]
    named = messages.withColumnsRenamed(dict(zip(names, order)))
    classified, watch = observed(classify(named, F.current_timestamp(), keep=tuple(order)))
    # Read three times below (time spans, insert, quarantine), decoded once.
    classified = classified.persist()
    try:
        events = accepted(classified, keep=tuple(order))
        try:
            insert_events(events, events_path, order or ["ingested_at"])
        except Exception:
            if counters_path:
                failed = [("ingestion_write_errors_total", {}, 1.0)]
                record(spark, counters_path, f"ingest-failed-{uuid.uuid4().hex}", batch_id, failed, when=when)
            raise
        counts = watch.get
        if counts["rejected"]:
            place = f"{quarantine_path}/stream={stream_id(spark)}/batch={batch_id}"
            quarantined(classified).write.mode("overwrite").parquet(place)
        if counters_path:
            count_batch(classified, counts, time.monotonic() - began, batch_id, counters_path, when)
        return counts
    finally:
        classified.unpersist()


def start_ingest(
    messages: DataFrame, events_path: str, quarantine_path: str, checkpoint: str,
    settings: IngestSettings = DEFAULTS, available_now: bool = False, counters_path: str | None = None,
) -> StreamingQuery:
    """Starts the ingest stream; ``available_now`` stops it at the end of input."""

    def write(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, events_path, quarantine_path, counters_path)

    writer = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{settings.batch_interval_ms} milliseconds").start()


def deduplicated(events: DataFrame, delay: str) -> DataFrame:
    """Watermarked alternative to the keyed insert, with bounded state. It does
    drop rows later than ``delay``, which the keyed insert never does."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id", "ts"])
