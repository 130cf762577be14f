"""Per-service time buckets and the reads that are plain aggregates of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RollupSettings
from ..functions.times import MICROS, bucket_start, instant
from ..schemas import ROLLUP, ROLLUP_KEY
from .filters import DATE_OF, on_or_after
from .quantile import select_quantile

DEFAULTS = RollupSettings()
P95 = 0.95
# Oversized groups known to the driver by name; a few megabytes at most.
MAX_LISTED_GROUPS = 50_000


def error_count() -> Column:
    return F.count_if(F.col("level") == "ERROR")


def _measures() -> list[Column]:
    """Measures of plain event rows that combine before the shuffle."""
    return [
        F.count("*").alias("event_count"),
        error_count().alias("error_count"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
    ]


def _counted_measures() -> list[Column]:
    """The same measures of rows that each stand for ``n`` events."""
    return [
        F.sum("n").alias("event_count"),
        F.sum("errors").alias("error_count"),
        (F.sum(F.col("latency_ms") * F.col("n")) / F.sum("n")).alias("avg_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
    ]


def event_measures(events: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, errors, mean and maximum latency of plain event rows per group."""
    return events.groupBy(*keys).agg(*_measures())


def rollup(
    events: DataFrame,
    width_s: int = DEFAULTS.width_s,
    hot_rows: int | None = DEFAULTS.hot_rows,
) -> DataFrame:
    """Counts, errors, mean, exact p95 and maximum per (bucket, service).

    Runs a counting job at once, unless ``hot_rows`` is None, which is for input
    whose groups are known to be small.
    """
    rows = events.select(
        bucket_start(F.col("ts"), width_s).alias("bucket"), "service", "level", "latency_ms"
    )
    return _by_bucket(rows, _measures(), None, hot_rows)


def rollup_counts(
    counts: DataFrame, hot_rows: int | None = DEFAULTS.hot_rows
) -> DataFrame:
    """The same rollup from (bucket, service, latency_ms, n, errors) rows."""
    return _by_bucket(counts, _counted_measures(), "n", hot_rows)


def _by_bucket(
    rows: DataFrame, measures: list[Column], weight: str | None, hot_rows: int | None
) -> DataFrame:
    """Groups above ``hot_rows`` rows get their percentile by selection.

    One counting job (two columns, combined before the shuffle) looks for such
    groups. Without any the plan is a plain aggregation.
    """
    names = ROLLUP.fieldNames()
    occurrences = () if weight is None else (F.col(weight),)
    p95 = F.percentile("latency_ms", P95, *occurrences).alias("p95_latency_ms")
    hot, few = (None, True) if hot_rows is None else _hot_groups(rows, hot_rows)
    if hot is None:
        return rows.groupBy(*ROLLUP_KEY).agg(*measures, p95).select(*names)
    numbered = rows.withColumn("_b", F.unix_micros("bucket"))
    ordinary = numbered.join(hot, ["_b", "service"], "left_anti")
    oversized = numbered.join(hot, ["_b", "service"], "left_semi")
    small = ordinary.groupBy(*ROLLUP_KEY).agg(*measures, p95)
    selected = select_quantile(
        oversized, ROLLUP_KEY, "latency_ms", P95, "p95_latency_ms", weight, few_groups=few
    )
    big = oversized.groupBy(*ROLLUP_KEY).agg(*measures).join(selected, ROLLUP_KEY)
    return small.select(*names).unionByName(big.select(*names))


def _hot_groups(rows: DataFrame, hot_rows: int) -> tuple[DataFrame | None, bool]:
    """Keys (_b, service) of the groups above ``hot_rows`` rows, None if there
    are none, and whether they are few.

    There are at most rows / ``hot_rows`` of them. Up to the listing limit they
    are a small local table to broadcast; beyond it they stay a query and are
    joined by shuffle, where the adaptive planner splits the skewed keys.
    """
    hot = (
        rows.groupBy(F.unix_micros("bucket").alias("_b"), "service")
        .agg(F.count("*").alias("_rows"))
        .filter(F.col("_rows") > hot_rows)
        .select("_b", "service")
    )
    listed = hot.limit(MAX_LISTED_GROUPS + 1).collect()
    if not listed:
        return None, True
    if len(listed) > MAX_LISTED_GROUPS:
        return hot, False
    return F.broadcast(rows.sparkSession.createDataFrame(listed, hot.schema)), True


def rollup_approx(
    events: DataFrame, width_s: int = DEFAULTS.width_s, accuracy: int = 10_000
) -> DataFrame:
    """Same columns with a sketched p95, for when an estimate is good enough."""
    rows = events.withColumn("bucket", bucket_start(F.col("ts"), width_s))
    sketch = F.percentile_approx("latency_ms", P95, accuracy).alias("p95_latency_ms")
    return rows.groupBy(*ROLLUP_KEY).agg(*_measures(), sketch).select(*ROLLUP.fieldNames())


def refresh_bounds(
    as_of, width_s: int, start_s: int, end_s: int
) -> tuple[Column, Column]:
    """First bucket start and end of the last bucket that a refresh recomputes:
    only buckets that lie wholly inside [as_of - start_s, as_of - end_s]."""
    clock = F.unix_micros(instant(as_of))
    earliest = F.timestamp_micros(clock - F.lit(start_s * MICROS))
    latest = F.timestamp_micros(clock - F.lit(end_s * MICROS))
    aligned = bucket_start(earliest, width_s)
    first = F.when(aligned == earliest, aligned).otherwise(
        F.timestamp_seconds(F.unix_seconds(aligned) + width_s)
    )
    return first, bucket_start(latest, width_s)


def refresh(
    table: DataFrame,
    events: DataFrame,
    as_of,
    width_s: int = DEFAULTS.width_s,
    start_s: int = DEFAULTS.refresh_start_s,
    end_s: int = DEFAULTS.refresh_end_s,
    hot_rows: int | None = DEFAULTS.hot_rows,
) -> DataFrame:
    """The rollup table with the closed buckets of the refresh range recomputed.

    Rows outside the range are kept as they are. Both sides are plain range
    filters, so they prune partitions and need no join.
    """
    first, last = refresh_bounds(as_of, width_s, start_s, end_s)
    bucket, ts = F.col("bucket"), F.col("ts")
    kept = table.filter((bucket < first) | (bucket >= last))
    touched = on_or_after(events, "ts", first).filter(ts < last)
    if DATE_OF["ts"] in events.columns:
        touched = touched.filter(F.col(DATE_OF["ts"]) <= F.to_date(last))
    names = ROLLUP.fieldNames()
    return kept.select(*names).unionByName(rollup(touched, width_s, hot_rows))


def late_arrivals(
    events: DataFrame, limit_s: int, width_s: int = DEFAULTS.width_s
) -> DataFrame:
    """Per bucket, how many rows arrived after the refresh had moved past them."""
    delay = F.unix_micros("ingested_at") - F.unix_micros("ts")
    late = events.filter(delay > F.lit(limit_s * MICROS))
    return late.groupBy(
        bucket_start(F.col("ts"), width_s).alias("bucket"), "service"
    ).agg(F.count("*").alias("late_events"), (F.max(delay) / MICROS).alias("max_delay_s"))


def service_stats(buckets: DataFrame) -> DataFrame:
    """Totals per service. The p95 is the plain mean of the buckets' p95s."""
    return buckets.groupBy("service").agg(
        F.coalesce(F.sum("event_count"), F.lit(0)).cast("long").alias("total_events"),
        F.coalesce(F.sum("error_count"), F.lit(0)).cast("long").alias("total_errors"),
        F.avg("p95_latency_ms").alias("avg_p95_latency_ms"),
        F.max("max_latency_ms").alias("max_latency_ms"),
    )


def mean_stddev(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and sample deviation; 0 where there are too few values for one."""
    return rows.groupBy(*keys).agg(
        F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stddev"),
    )


def series(buckets: DataFrame, width_s: int, chunk_s: int) -> DataFrame:
    """Ordered series per service, cut into time chunks so no array is unbounded."""
    chunk = bucket_start(F.col("bucket"), chunk_s).alias("chunk")
    point = F.struct("bucket", "event_count", "error_count", "p95_latency_ms", "max_latency_ms")
    return buckets.groupBy("service", chunk).agg(
        F.sort_array(F.collect_list(point)).alias("points")
    )
