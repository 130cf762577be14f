"""The dashboard and engine reads over the rollup and the anomaly table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import HOUR, ReadSettings
from ..functions.scoring import error_rate, health_status
from ..functions.text import fixed_point, grouped_integer
from ..functions.times import time_ago
from .filters import matching, since
from .rollup import service_stats

READS = ReadSettings()
# Completes the order of rows that were detected at the same moment.
TIES = ["service", "anomaly_type", "bucket_ts"]
DASH = "—"


def in_series_order(buckets: DataFrame) -> DataFrame:
    """Each service oldest first."""
    return buckets.orderBy("service", "bucket")


def recent_buckets(buckets: DataFrame, as_of, window_s: int) -> DataFrame:
    """Buckets of the detection window, each service oldest first."""
    return in_series_order(since(buckets, "bucket", as_of, window_s))


def buckets_fetched(buckets: DataFrame, as_of, window_s: int) -> DataFrame:
    return since(buckets, "bucket", as_of, window_s).agg(
        F.count("*").alias("buckets_fetched")
    )


def _newest(anomalies: DataFrame, limit: int) -> DataFrame:
    return anomalies.orderBy(F.col("detected_at").desc(), *TIES).limit(limit)


def anomaly_feed(
    anomalies: DataFrame, as_of, hours: float = READS.feed_hours,
    limit: int = READS.feed_limit,
) -> DataFrame:
    return _newest(since(anomalies, "detected_at", as_of, hours * HOUR), limit)


def context_anomalies(
    anomalies: DataFrame, as_of, hours: float = READS.lookback_hours,
    service: str | None = None, limit: int = READS.context_limit,
) -> DataFrame:
    recent = matching(
        since(anomalies, "detected_at", as_of, hours * HOUR), "service", service
    )
    return _newest(recent.drop("id", "baseline_stddev"), limit)


def context_stats(
    buckets: DataFrame, as_of, hours: float = READS.lookback_hours,
    service: str | None = None,
) -> DataFrame:
    recent = matching(since(buckets, "bucket", as_of, hours * HOUR), "service", service)
    return service_stats(recent).orderBy("service")


def service_health(
    buckets: DataFrame, as_of, hours: float = READS.health_hours
) -> DataFrame:
    """Totals per service with the error rate, services in order."""
    return with_health(service_stats(since(buckets, "bucket", as_of, hours * HOUR))).orderBy(
        "service"
    )


def with_health(stats: DataFrame) -> DataFrame:
    rate = error_rate(F.col("total_events"), F.col("total_errors"))
    return stats.withColumn("error_rate", rate)


def feed_lines(feed: DataFrame, as_of) -> DataFrame:
    """One display line per anomaly of a feed, newest first."""
    two = [fixed_point(F.col(c), 2, ties="up")
           for c in ("metric_value", "baseline_mean", "z_score")]
    values = F.concat(
        F.lit("value="), two[0], F.lit(" baseline="), two[1], F.lit(" z="), two[2]
    )
    what = F.concat_ws(" · ", "service", "anomaly_type", values)
    line = F.concat_ws(" ", time_ago(as_of, F.col("detected_at")), "severity", what)
    return feed.orderBy(F.col("detected_at").desc(), *TIES).select(
        "id", "detected_at", line.alias("line")
    )


def health_cards(health: DataFrame) -> DataFrame:
    """The texts of one card per service."""

    def millis(name: str):
        shown = F.concat(fixed_point(F.col(name), 0, ties="up"), F.lit("ms"))
        return F.coalesce(shown, F.lit(DASH))

    rate = F.col("error_rate")
    return health.select(
        "service",
        health_status(rate).alias("status"),
        grouped_integer(F.col("total_events")).alias("events"),
        F.concat(fixed_point(rate * 100, 1, ties="up"), F.lit("%")).alias("error_rate_text"),
        millis("avg_p95_latency_ms").alias("p95_latency"),
        millis("max_latency_ms").alias("max_latency"),
    ).orderBy("service")
