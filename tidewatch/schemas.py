"""Declared schemas. Nothing in this package infers a schema from data."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(*fields: tuple) -> StructType:
    return StructType([StructField(*f) for f in fields])


# The JSON message. Order matters: it is the order of the published keys.
LOG_EVENT_JSON = _struct(
    ("event_id", StringType()),
    ("timestamp", StringType()),
    ("service", StringType()),
    ("endpoint", StringType()),
    ("level", StringType()),
    ("status_code", IntegerType()),
    ("latency_ms", DoubleType()),
    ("message", StringType()),
    ("trace_id", StringType()),
    ("anomaly_injected", BooleanType()),
)

LOG_EVENTS = _struct(
    ("event_id", StringType(), False),
    ("ts", TimestampType(), False),
    ("service", StringType(), False),
    ("endpoint", StringType(), False),
    ("level", StringType(), False),
    ("status_code", IntegerType(), False),
    ("latency_ms", DoubleType(), False),
    ("message", StringType(), False),
    ("trace_id", StringType(), False),
    ("anomaly_injected", BooleanType(), False),
    ("ingested_at", TimestampType(), False),
)
LOG_EVENT_KEY = ["event_id", "ts"]

ROLLUP = _struct(
    ("bucket", TimestampType()),
    ("service", StringType()),
    ("event_count", LongType()),
    ("error_count", LongType()),
    ("avg_latency_ms", DoubleType()),
    ("p95_latency_ms", DoubleType()),
    ("max_latency_ms", DoubleType()),
)
ROLLUP_KEY = ["bucket", "service"]

ANOMALIES = _struct(
    ("id", StringType(), False),
    ("detected_at", TimestampType(), False),
    ("bucket_ts", TimestampType(), False),
    ("service", StringType(), False),
    ("anomaly_type", StringType(), False),
    ("metric_value", DoubleType(), False),
    ("baseline_mean", DoubleType(), False),
    ("baseline_stddev", DoubleType(), False),
    ("z_score", DoubleType(), False),
    ("severity", StringType(), False),
)

# A later judgement of a finding: other values, or withdrawn.
ANOMALY_VERSIONS = StructType([
    *ANOMALIES.fields, StructField("version", LongType(), False), StructField("withdrawn", BooleanType(), False),
])

SERVICE_STATS = _struct(
    ("service", StringType()),
    ("total_events", LongType()),
    ("total_errors", LongType()),
    ("avg_p95_latency_ms", DoubleType()),
    ("max_latency_ms", DoubleType()),
)

METRIC_SAMPLES = _struct(
    ("metric", StringType()),
    ("labels", MapType(StringType(), StringType())),
    ("ts", TimestampType()),
    ("value", DoubleType()),
)

QUESTIONS = _struct(
    ("question_id", LongType()),
    ("query", StringType()),
    ("service", StringType()),
    ("lookback_hours", IntegerType()),
    ("as_of", TimestampType()),
)

# Element types of the two arrays in a retrieved context.
CONTEXT_ANOMALY = StructType(
    [f for f in ANOMALIES.fields if f.name not in ("id", "baseline_stddev")]
)
CONTEXT_ANOMALIES = ArrayType(CONTEXT_ANOMALY)
CONTEXT_STATS = ArrayType(SERVICE_STATS)


def with_partition(schema: StructType, column: str) -> StructType:
    """The stored form of a table: its columns plus the date partition."""
    return StructType([*schema.fields, StructField(column, DateType())])
