"""Kafka topics as streaming DataFrames, and events as keyed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..config import IngestSettings
from ..functions.times import iso_format
from ..schemas import LOG_EVENT_JSON

DEFAULTS = IngestSettings()

# What the topic reader gives.
MESSAGE = (
    "key binary, value binary, topic string, partition int, offset long,"
    " timestamp timestamp, timestampType int"
)


def reader_options(
    brokers: str, topic: str = DEFAULTS.topic, starting: str = "latest",
    settings: IngestSettings = DEFAULTS, max_per_trigger: int | None = None,
) -> dict[str, str]:
    """Options of the topic reader.

    A micro-batch starts when ``batch_size`` messages wait or ``batch_interval_ms``
    have passed. ``max_per_trigger`` is the back-pressure limit, by default that of the
    settings; ``counters.messages_per_trigger`` derives one from measured batches.
    """
    options = {
        "kafka.bootstrap.servers": brokers,
        "subscribe": topic,
        "startingOffsets": starting,
        "kafka.fetch.min.bytes": "1",
        "kafka.fetch.max.bytes": str(settings.max_fetch_bytes),
        "minOffsetsPerTrigger": str(settings.batch_size),
        "maxTriggerDelay": f"{settings.batch_interval_ms}ms",
    }
    limit = max(max_per_trigger or settings.max_per_trigger, settings.batch_size)
    options["maxOffsetsPerTrigger"] = str(limit)
    return options


def log_messages(spark: SparkSession, brokers: str, **kwargs) -> DataFrame:
    """The topic as a stream of (key, value, topic, partition, offset, timestamp).

    The query's checkpoint keeps the position. It moves after a batch is
    written, so a batch whose write failed is read again.
    """
    return spark.readStream.format("kafka").options(**reader_options(brokers, **kwargs)).load()


def as_json() -> Column:
    """An event row as the JSON text of its message."""
    fields = [
        iso_format(F.col("ts")).alias(name) if name == "timestamp" else F.col(name)
        for name in LOG_EVENT_JSON.fieldNames()
    ]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def records(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Events as (key, value) bytes: the service, and the event as JSON."""
    return events.select(
        *keep,
        F.col("service").cast("binary").alias("key"),
        as_json().cast("binary").alias("value"),
    )


def publish(events: DataFrame, brokers: str, topic: str = DEFAULTS.topic) -> None:
    """Writes a batch of events to the topic."""
    records(events).write.format("kafka").option(
        "kafka.bootstrap.servers", brokers
    ).option("topic", topic).save()


def publish_stream(
    events: DataFrame, brokers: str, checkpoint: str, topic: str = DEFAULTS.topic
) -> DataStreamWriter:
    return (
        records(events)
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
    )
