"""Every operator as a named query over the sample tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import TimestampType

from ..config import DAY, HOUR, MINUTE
from ..functions import scoring, text, times
from ..operators import (
    baseline, context, decode, detect, filters, keys, metrics, questions, reads, rollup,
)
from ..schemas import LOG_EVENTS
from ..session import shared_dir
from ..sources import kafka, samples, tables
from ..sources.samples import AS_OF, SETTINGS, WIDTH_S
from ..streaming import counters
from ..streaming import detect as stream_detect
from ..streaming import ewma as stream_ewma
from ..streaming import refold
from ..streaming import ingest as stream_ingest
from ..streaming import rollup as stream_rollup
from . import panels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FEED_HOURS = 168
RATE_WINDOW_S, RATE_STEP_S = 6 * HOUR, HOUR
SCRAPE_S = 10 * MINUTE
LATENCY_BOUNDS = metrics.BATCH_SIZE_BOUNDS
REFRESH = (10 * DAY, DAY)


def query(function: Query) -> Query:
    """Registers a query under its function's name, results in plain form."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return plain(function(spark, sf_dir))

    QUERIES[function.__name__] = run
    return function


def plain(df: DataFrame) -> DataFrame:
    """Timestamps without zone, for comparison with other engines."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, TimestampType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def six(column: Column | str) -> Column:
    """Six decimals. The slightly raised half keeps values that two engines
    compute a last bit apart from falling on different sides."""
    c = F.col(column) if isinstance(column, str) else column
    return F.floor(c * 1e6 + 0.5013) / 1e6


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: six(n) for n in names})


# ---- inputs ---------------------------------------------------------------


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.log_events(spark, sf_dir)


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = rollup.rollup(logs(spark, sf_dir), WIDTH_S)
    return rounded(rolled, "avg_latency_ms", "p95_latency_ms")


def stored_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup as a written table, for queries that read it several times."""
    path = shared_dir(spark, "rollup")
    tables.ROLLUP_TABLE.write(buckets(spark, sf_dir), path)
    return tables.ROLLUP_TABLE.read(spark, path)


FOUND = ["metric_value", "baseline_mean", "baseline_stddev", "z_score"]


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies_of(buckets(spark, sf_dir))


def anomalies_of(rolled: DataFrame) -> DataFrame:
    found = detect.detect(rolled, SETTINGS)
    when = F.timestamp_seconds(F.unix_seconds("bucket_ts") + 2 * HOUR)
    return rounded(detect.as_records(found, when), *FOUND)


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.questions(spark, sf_dir)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a JSON message; each remainder of its number by 8 gives a
    different form, some of them faulty."""
    events = logs(spark, sf_dir)
    number = F.substring("event_id", 25, 12).cast("long")
    body = kafka.as_json()
    form = F.pmod(number, F.lit(8))
    tails = F.array(*[F.lit(t) for t in (
        " tail", ',"a":1', ',"end":0', ',"message":{}', "]junk", ',{"end":0}]', "}", ',{"event_id":"a"}',
    )])
    value = (
        F.when(form == 1, F.concat(body, F.element_at(tails, (F.pmod(number, F.lit(64)) / 8 + 1).cast("int"))))
        .when(form == 2, F.regexp_replace(body, '"status_code":([0-9]+)', '"status_code":"$1"'))
        .when(form == 3, F.regexp_replace(body, r"\}$", ',"extra":[1,2]}'))
        .when(form == 4, F.regexp_replace(body, '"level":"[A-Z]+"', '"level":null'))
        .when(form == 5, F.regexp_replace(body, r"T(\d\d:\d\d:\d\d)", " $1"))
        .when(form == 6, F.regexp_replace(body, '"trace_id":"00000000-', '"trace_id":"'))
        .otherwise(body)
    )
    return events.select(number.alias("number"), "service", value.alias("value"))


def counter(events: DataFrame) -> DataFrame:
    """Scraped counter of events per service that restarts at midnight."""
    slot = times.bucket_start(F.col("ts"), SCRAPE_S)
    counts = events.groupBy("service", slot.alias("_slot")).agg(F.count("*").alias("_n"))
    day = Window.partitionBy("service", F.to_date("_slot")).orderBy("_slot")
    running = F.sum("_n").over(day.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counts.select(
        "service",
        F.timestamp_seconds(F.unix_seconds("_slot") + SCRAPE_S).alias("ts"),
        running.cast("double").alias("value"),
    )


def samples_of(rows: DataFrame, metric: str, labels: list[str]) -> DataFrame:
    """Rows as samples of a metric with the named columns as labels."""
    pairs = [part for name in labels for part in (F.lit(name), F.col(name))]
    return rows.select(
        F.lit(metric).alias("metric"), F.create_map(*pairs).alias("labels"), "ts", "value"
    )


def latency_counter(events: DataFrame) -> DataFrame:
    """Scraped histogram counter of latencies per service, hourly."""
    hourly = metrics.histogram(
        events.withColumn("hour", times.bucket_start(F.col("ts"), HOUR)),
        ["service", "hour"], "latency_ms", LATENCY_BOUNDS,
    )
    w = Window.partitionBy("service", "le").orderBy("hour").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return hourly.select(
        "service",
        metrics.le_label(F.col("le")).alias("le"),
        F.timestamp_seconds(F.unix_seconds("hour") + HOUR).alias("ts"),
        F.sum("cumulative_count").over(w).cast("double").alias("value"),
    )


def anomaly_counter(found: DataFrame) -> DataFrame:
    """Counter of detected anomalies per service, type and severity."""
    series = ["service", "anomaly_type", "severity"]
    counts = found.groupBy(*series, F.col("detected_at").alias("ts")).agg(
        F.count("*").alias("_n")
    )
    w = Window.partitionBy(*series).orderBy("ts").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return counts.select(*series, "ts", F.sum("_n").over(w).cast("double").alias("value"))


# ---- scans, sources, sinks -----------------------------------------------


@query
def src_log_events(spark, sf_dir):
    return logs(spark, sf_dir)


@query
def src_recent_buckets(spark, sf_dir):
    return reads.recent_buckets(buckets(spark, sf_dir), AS_OF, SETTINGS.window_s)


@query
def sink_events_idempotent(spark, sf_dir):
    """Redelivered events inserted twice; the table as it is afterwards."""
    path = shared_dir(spark, "events")
    rows = samples.redelivered(logs(spark, sf_dir))
    tables.insert_events(rows, path)
    tables.insert_events(rows, path)
    return tables.EVENTS_TABLE.read(spark, path).select(*LOG_EVENTS.fieldNames())


@query
def sink_anomalies(spark, sf_dir):
    path = shared_dir(spark, "anomalies")
    rows = anomalies(spark, sf_dir).persist()
    tables.insert_anomalies(rows, path)
    tables.insert_anomalies(rows, path)
    rows.unpersist()
    return tables.ANOMALY_TABLE.read(spark, path).drop("detected_date")


@query
def sink_time_partitioned(spark, sf_dir):
    """Last week of a date-partitioned copy, older dates not read."""
    path = shared_dir(spark, "events-by-date")
    tables.EVENTS_TABLE.write(logs(spark, sf_dir), path)
    stored = tables.EVENTS_TABLE.read(spark, path)
    return filters.since(stored, "ts", AS_OF, 7 * DAY).select(
        "event_id", "ts", "service", "event_date"
    )


@query
def sink_kafka_records(spark, sf_dir):
    rows = kafka.records(logs(spark, sf_dir))
    return rows.select(*[F.col(c).cast("string").alias(c) for c in ("key", "value")])


@query
def src_kafka_logs(spark, sf_dir):
    """The ingest stream over rows in the shape a topic reader gives: every
    message is delivered twice, the higher offset with another text."""
    path = shared_dir(spark, "topic")
    events = logs(spark, sf_dir).withColumn("number", F.substring("event_id", 25, 12).cast("long"))
    again = events.withColumns(
        {"message": F.concat("message", F.lit(" (again)")), "number": F.col("number") + 10**12}
    )
    both = events.unionByName(again)
    kafka.records(both, keep=("ts", "number")).select(
        "key", "value", F.lit("service-logs").alias("topic"), F.lit(0).alias("partition"),
        F.col("number").alias("offset"), F.col("ts").alias("timestamp"),
        F.lit(0).alias("timestampType"),
    ).write.parquet(f"{path}/topic")
    source = spark.readStream.schema(kafka.MESSAGE).parquet(f"{path}/topic")
    stream_ingest.start_ingest(
        source, f"{path}/events", f"{path}/quarantine", f"{path}/checkpoint", available_now=True
    ).awaitTermination()
    return tables.EVENTS_TABLE.read(spark, f"{path}/events").drop("ingested_at", "event_date")


@query
def obs_ingest_counts(spark, sf_dir):
    """Messages read, accepted and turned away, by reason."""
    return decode.outcomes(decode.classify(messages(spark, sf_dir), AS_OF))


@query
def obs_pipeline_counts(spark, sf_dir):
    """Final values of all counters that do not depend on how fast the machine is, after three
    batches of messages and one detection cycle."""
    path = shared_dir(spark, "counted")
    every = messages(spark, sf_dir)
    for k in range(3):
        stream_ingest.ingest_batch(
            every.filter(F.col("number") % 3 == k).select("value"), k, f"{path}/events", f"{path}/quarantine",
            f"{path}/counters",
        )
    rolled = buckets(spark, sf_dir)
    tables.ROLLUP_TABLE.write(rolled, f"{path}/rollup")
    stream_detect.detect_batch(
        tables.ROLLUP_TABLE.read(spark, f"{path}/rollup"), 0, f"{path}/rollup", f"{path}/anomalies", f"{path}/state",
        SETTINGS, AS_OF, counters_path=f"{path}/counters",
    )
    samples = panels.with_series(counters.samples(spark, f"{path}/counters"))
    timed = F.col("metric").contains("_seconds_") & ~F.col("metric").endswith("_count")
    return samples.filter(~timed).groupBy("metric", "series").agg(F.max("value").alias("value"))


# ---- projections, filters, constraints -----------------------------------


@query
def proj_decode_json(spark, sf_dir):
    rows = decode.decode(messages(spark, sf_dir), keep=("number",))
    return rows.filter(F.col("decode_error").isNull()).drop("raw", "decode_error")


@query
def st_quarantine(spark, sf_dir):
    """What the ingest stream set aside, after a run to the end of its input."""
    place, _ = _ingest_stream(spark, sf_dir)
    stored = spark.read.schema("raw string, reject_reason string").parquet(
        f"{place}/quarantine/*/*"
    )
    return stored.select("raw", "reject_reason")


def _ingest_stream(spark, sf_dir) -> tuple[str, DataFrame]:
    place = shared_dir(spark, "ingest")
    messages(spark, sf_dir).select("value").write.parquet(f"{place}/topic")
    source = spark.readStream.schema("value string").parquet(f"{place}/topic")
    stream_ingest.start_ingest(
        source, f"{place}/events", f"{place}/quarantine", f"{place}/checkpoint",
        available_now=True,
    ).awaitTermination()
    return place, tables.EVENTS_TABLE.read(spark, f"{place}/events")


@query
def st_ingest(spark, sf_dir):
    """The event table after the ingest stream has read every message."""
    _, stored = _ingest_stream(spark, sf_dir)
    return stored.drop("ingested_at", "event_date")


def _timestamp_texts(spark, sf_dir) -> DataFrame:
    """Every event's time in one of six spellings, three of them invalid."""
    second = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    micro = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    form = F.pmod(F.unix_micros("ts"), F.lit(6))
    spelled = (
        F.when(form == 0, F.concat(micro, F.lit("Z")))
        .when(form == 1, F.concat(micro, F.lit("789+05:30")))
        .when(form == 2, F.concat(second, F.lit("-08:00")))
        .when(form == 3, F.date_format("ts", "yyyy-MM-dd"))
        .when(form == 4, F.concat(F.regexp_replace(micro, "T", " "), F.lit("Z")))
        .otherwise(micro)
    )
    return logs(spark, sf_dir).select("event_id", "service", spelled.alias("timestamp"))


@query
def proj_parse_ts(spark, sf_dir):
    return decode.parse_timestamps(_timestamp_texts(spark, sf_dir))


@query
def flt_valid_ts(spark, sf_dir):
    return decode.with_valid_ts(decode.parse_timestamps(_timestamp_texts(spark, sf_dir)))


def _faulty(spark, sf_dir) -> DataFrame:
    """Events with missing values and broken ids, depending on their kind."""
    kind = F.regexp_extract("message", "handled (.*)", 1)
    return logs(spark, sf_dir).withColumns(
        {
            "endpoint": F.when(kind != "view", F.col("endpoint")),
            "trace_id": F.when(kind == "click", F.concat("trace_id", F.lit("0"))).otherwise(
                F.col("trace_id")
            ),
            "event_id": F.when(
                F.col("level") == "WARN", F.upper(F.replace("event_id", F.lit("-"), F.lit("")))
            ).otherwise(F.col("event_id")),
        }
    )


@query
def chk_constraints(spark, sf_dir):
    rows = _faulty(spark, sf_dir)
    return rows.select(
        text.canonical_uuid(F.col("event_id")).alias("event_id"),
        decode.constraint_violation(rows.columns).alias("reject_reason"),
    )


@query
def chk_level_status(spark, sf_dir):
    """Contradictions per service after every slow event was logged as ERROR."""
    level = F.when(F.col("latency_ms") > 100, "ERROR").otherwise(F.col("level"))
    rows = decode.level_mismatches(logs(spark, sf_dir).withColumn("level", level))
    return rows.groupBy("service").agg(F.count("*").alias("violations"))


@query
def proj_defaults(spark, sf_dir):
    gaps = logs(spark, sf_dir).withColumns(
        {
            "anomaly_injected": F.when(F.col("level") == "ERROR", F.col("anomaly_injected")),
            "ingested_at": F.when(F.col("level") != "WARN", F.col("ingested_at")),
        }
    )
    filled = decode.apply_defaults(gaps, AS_OF)
    return filled.select("event_id", "anomaly_injected", "ingested_at")


@query
def flt_lookback(spark, sf_dir):
    return filters.since(logs(spark, sf_dir), "ts", AS_OF, 72 * HOUR).select(
        "event_id", "ts", "service"
    )


@query
def flt_optional_eq(spark, sf_dir):
    """Events counted with and without a wanted service."""
    events = logs(spark, sf_dir)
    parts = [
        filters.matching(events, "service", wanted).agg(
            F.lit(wanted or "any").alias("wanted"), F.count("*").alias("n")
        )
        for wanted in ("payments", None)
    ]
    return parts[0].unionByName(parts[1])


@query
def flt_error_events(spark, sf_dir):
    rows = filters.error_events(logs(spark, sf_dir))
    return filters.newest_first(rows, "ts", "event_id").select("event_id", "ts", "service")


@query
def flt_injected_events(spark, sf_dir):
    rows = filters.injected_events(logs(spark, sf_dir))
    return filters.newest_first(rows, "ts", "event_id").select("event_id", "ts", "service")


@query
def flt_service_range(spark, sf_dir):
    rows = filters.matching(logs(spark, sf_dir), "service", "checkout")
    week = filters.between(
        rows, "ts", times.instant("2024-01-08 00:00:00"), times.instant("2024-01-15 00:00:00")
    )
    return filters.newest_first(week, "ts", "event_id").select("event_id", "ts", "latency_ms")


@query
def flt_critical_anomalies(spark, sf_dir):
    return filters.newest_first(
        filters.critical(anomalies(spark, sf_dir)), "detected_at", *reads.TIES
    )


# ---- joins ----------------------------------------------------------------


@query
def join_anti_conflict(spark, sf_dir):
    """New keys of all redelivered events against the first half of the month."""
    events = logs(spark, sf_dir)
    existing = events.filter(F.col("ts") < times.instant("2024-01-16 00:00:00"))
    incoming = samples.redelivered(events)
    return keys.without_known_keys(incoming, existing).select("event_id", "ts", "message")


@query
def join_question_anomalies(spark, sf_dir):
    return questions.question_anomalies(asked(spark, sf_dir), anomalies(spark, sf_dir))


@query
def join_question_stats(spark, sf_dir):
    found = questions.question_stats(
        asked(spark, sf_dir), stored_buckets(spark, sf_dir), WIDTH_S
    )
    return rounded(found, "avg_p95_latency_ms")


# ---- aggregations ---------------------------------------------------------


@query
def agg_rollup_1min(spark, sf_dir):
    return buckets(spark, sf_dir)


@query
def agg_rollup_hot_groups(spark, sf_dir):
    """The rollup with selection instead of value maps for all busier groups."""
    rolled = rollup.rollup(logs(spark, sf_dir), WIDTH_S, hot_rows=8)
    return rounded(rolled, "avg_latency_ms", "p95_latency_ms")


@query
def agg_count_filter(spark, sf_dir):
    return logs(spark, sf_dir).groupBy("service").agg(
        rollup.error_count().alias("error_count")
    )


@query
def agg_percentile_cont(spark, sf_dir):
    """p95 per service and day, by the rollup at a day's width."""
    daily = rollup.rollup(logs(spark, sf_dir), DAY).select("bucket", "service", "p95_latency_ms")
    return rounded(daily, "p95_latency_ms")


@query
def agg_avg_max_count(spark, sf_dir):
    rows = rollup.event_measures(logs(spark, sf_dir), ["service"])
    return rounded(rows.drop("error_count"), "avg_latency_ms")


@query
def agg_service_stats(spark, sf_dir):
    return rounded(rollup.service_stats(buckets(spark, sf_dir)), "avg_p95_latency_ms")


@query
def agg_mean_stddev(spark, sf_dir):
    """Over whole services, and over single buckets where one value is common."""
    rows = buckets(spark, sf_dir).withColumn("day", F.to_date("bucket"))
    return rounded(
        rollup.mean_stddev(rows, ["service", "day"], "p95_latency_ms"), "mean", "stddev"
    )


@query
def agg_series(spark, sf_dir):
    """Points of the ordered weekly series with their position."""
    chunked = rollup.series(buckets(spark, sf_dir), WIDTH_S, 7 * DAY)
    return chunked.select("service", "chunk", F.posexplode("points").alias("pos", "p")).select(
        "service", "chunk", "pos", "p.*"
    )


@query
def agg_dedupe_events(spark, sf_dir):
    return keys.first_arrivals(samples.redelivered(logs(spark, sf_dir)), ["ingested_at"])


@query
def agg_events_consumed(spark, sf_dir):
    return keys.consumed_counts(decode.decode(messages(spark, sf_dir)))


@query
def agg_events_written(spark, sf_dir):
    return keys.written_counts(samples.redelivered(logs(spark, sf_dir)))


@query
def agg_anomaly_counts(spark, sf_dir):
    return detect.anomaly_counts(anomalies(spark, sf_dir))


@query
def agg_buckets_fetched(spark, sf_dir):
    return reads.buckets_fetched(buckets(spark, sf_dir), AS_OF, SETTINGS.window_s)


@query
def agg_histogram(spark, sf_dir):
    counted = metrics.histogram(
        logs(spark, sf_dir), ["service"], "latency_ms", LATENCY_BOUNDS
    )
    return rounded(counted.withColumn("le", metrics.le_label(F.col("le"))), "total_sum")


# ---- windows and detectors -------------------------------------------------


@query
def win_current_vs_history(spark, sf_dir):
    rows = detect.current_and_history(buckets(spark, sf_dir), "2024-01-29 12:00:00", SETTINGS)
    return rounded(
        rows.select("service", "bucket", "history", "p95_mean", "p95_stddev"),
        "p95_mean", "p95_stddev",
    )


@query
def win_min_history(spark, sf_dir):
    return baseline.trailing_baseline(buckets(spark, sf_dir), SETTINGS).select(
        "service", "bucket", "history", "eligible"
    )


@query
def win_baseline(spark, sf_dir):
    names = ["p95_mean", "p95_stddev", "max_mean", "max_stddev"]
    rows = baseline.trailing_baseline(buckets(spark, sf_dir), SETTINGS)
    return rounded(rows.select("service", "bucket", *names), *names)


@query
def win_ewma(spark, sf_dir):
    rows = detect.score(buckets(spark, sf_dir), SETTINGS).filter(F.col("ewma").isNotNull())
    return rounded(rows.select("service", "bucket", "rate", "ewma"), "rate", "ewma")


def _found(rows: DataFrame) -> DataFrame:
    return rounded(rows, *FOUND)


@query
def det_latency_spike(spark, sf_dir):
    return _found(detect.latency_spikes(buckets(spark, sf_dir), SETTINGS))


@query
def det_max_latency_outlier(spark, sf_dir):
    return _found(detect.max_latency_outliers(buckets(spark, sf_dir), SETTINGS))


@query
def det_error_burst(spark, sf_dir):
    return _found(detect.error_bursts(buckets(spark, sf_dir), SETTINGS))


@query
def det_all(spark, sf_dir):
    return anomalies(spark, sf_dir)


SNAPSHOT_AT = "2024-01-05 18:30:00"


@query
def det_snapshot(spark, sf_dir):
    return _found(detect.snapshot(stored_buckets(spark, sf_dir), SNAPSHOT_AT, SETTINGS))


@query
def set_union_anomalies(spark, sf_dir):
    """Findings per detector in the union of all three."""
    rows = detect.detect(buckets(spark, sf_dir), SETTINGS)
    return rows.groupBy("anomaly_type").agg(F.count("*").alias("findings"))


# ---- reads ------------------------------------------------------------------


@query
def top_anomaly_feed(spark, sf_dir):
    return reads.anomaly_feed(anomalies(spark, sf_dir), AS_OF, FEED_HOURS)


@query
def top_context_anomalies(spark, sf_dir):
    return reads.context_anomalies(anomalies(spark, sf_dir), AS_OF, FEED_HOURS, "checkout")


@query
def sort_series(spark, sf_dir):
    return reads.in_series_order(buckets(spark, sf_dir)).select("service", "bucket", "event_count")


@query
def view_service_health(spark, sf_dir):
    rows = reads.service_health(buckets(spark, sf_dir), AS_OF, FEED_HOURS)
    return rounded(rows, "avg_p95_latency_ms", "error_rate")


@query
def view_feed_lines(spark, sf_dir):
    feed = reads.anomaly_feed(
        anomalies(spark, sf_dir), AS_OF, FEED_HOURS, reads.READS.ui_feed_limit
    )
    return reads.feed_lines(feed, AS_OF)


@query
def view_health_cards(spark, sf_dir):
    health = reads.service_health(buckets(spark, sf_dir), AS_OF, FEED_HOURS)
    return reads.health_cards(health)


# ---- scalar functions --------------------------------------------------------


@query
def fn_time_bucket(spark, sf_dir):
    ts = F.col("ts")
    return logs(spark, sf_dir).select(
        "event_id",
        times.bucket_start(ts, MINUTE).alias("minute"),
        times.bucket_start(ts, 7 * MINUTE).alias("seven_minutes"),
        times.bucket_start(ts, 7 * DAY).alias("week"),
    )


def _rate_query(name: str, function, *, empty: bool) -> None:
    def run(spark, sf_dir):
        rows = buckets(spark, sf_dir)
        # Buckets without errors stand in for buckets without events.
        events = F.when(F.col("error_count") > 0, F.col("event_count"))
        if empty:
            events = F.coalesce(events, F.lit(0))
        rate = function(events, F.col("error_count"))
        return rows.select("service", "bucket", six(rate).alias("rate"))

    run.__name__ = name
    query(run)


_rate_query("fn_error_rate", scoring.error_rate, empty=False)
_rate_query("fn_error_pct", scoring.error_pct, empty=False)
_rate_query("fn_burst_rate", scoring.burst_rate, empty=True)


def _deviation() -> Column:
    """A z-like number of both signs for every event, NaN for views."""
    z = (F.col("latency_ms") - 40) / 10
    return F.when(F.col("message").endswith("view"), F.lit(float("nan"))).otherwise(z)


@query
def fn_severity_directional(spark, sf_dir):
    level = scoring.severity_upward(_deviation(), SETTINGS.z_warning, SETTINGS.z_critical)
    return logs(spark, sf_dir).select("event_id", level.alias("severity"))


@query
def fn_severity_bidirectional(spark, sf_dir):
    level = scoring.severity_both_ways(_deviation(), SETTINGS.z_warning, SETTINGS.z_critical)
    return logs(spark, sf_dir).select("event_id", level.alias("severity"))


@query
def fn_ewma_z(spark, sf_dir):
    rate = F.col("error_count") / F.col("event_count")
    z = scoring.ewma_z(rate, F.col("avg_latency_ms") / 1000)
    return buckets(spark, sf_dir).select("service", "bucket", six(z).alias("z"))


@query
def fn_health_status(spark, sf_dir):
    rate = F.col("error_count") / F.col("event_count")
    return buckets(spark, sf_dir).select(
        "service", "bucket", scoring.health_status(rate).alias("status")
    )


@query
def fn_level_from_status(spark, sf_dir):
    return logs(spark, sf_dir).select(
        "event_id", scoring.level_from_status(F.col("status_code")).alias("level")
    )


@query
def fn_time_ago(spark, sf_dir):
    clock = F.timestamp_seconds(F.unix_seconds("ingested_at") + F.col("status_code"))
    return logs(spark, sf_dir).select(
        "event_id",
        times.time_ago(AS_OF, F.col("ts")).alias("age"),
        times.time_ago(clock, F.col("ts")).alias("short_age"),
    )


def _parameter() -> Column:
    """Parameter texts of every kind, from each event's latency and kind."""
    number = F.format_string("%.2f", F.col("latency_ms"))
    kind = F.regexp_extract("message", "handled (.*)", 1)
    return (
        F.when(kind == "error", F.concat(F.lit("-"), number))
        .when(kind == "view", F.concat(F.lit(" "), number, F.lit("\t")))
        .when(kind == "click", F.concat(number, F.lit("x")))
        .when(kind == "signup", F.lit(""))
        .when(F.col("latency_ms") > 50, number)
    )


@query
def fn_positive_param(spark, sf_dir):
    return logs(spark, sf_dir).select(
        "event_id", text.positive_or(_parameter(), 24).alias("parameter")
    )


@query
def fn_num_or_zero(spark, sf_dir):
    return logs(spark, sf_dir).select(
        "event_id",
        text.number_or_zero(_parameter()).alias("number"),
        text.number_or_null(_parameter()).alias("nullable_number"),
    )


@query
def fn_lookback_default(spark, sf_dir):
    hours = times.lookback_hours(F.col("lookback_hours"), reads.READS.lookback_hours)
    return asked(spark, sf_dir).select("question_id", hours.alias("hours"))


@query
def fn_window_bounds(spark, sf_dir):
    return questions.with_window(asked(spark, sf_dir)).select(
        "question_id", "window_start", "window_end"
    )


@query
def fn_fixed_format(spark, sf_dir):
    """Latencies, and their eighths, which often end in a true tie."""
    eighth = F.floor(F.col("latency_ms") * 8) / 8
    shown = {
        "two": text.fixed_point(F.col("latency_ms") / 3, 2),
        "one": text.fixed_point(F.col("latency_ms"), 1),
        "none": text.fixed_point(1 - F.col("latency_ms"), 0),
        "tie_even": text.fixed_point(eighth, 2),
        "tie_up": text.fixed_point(eighth, 2, ties="up"),
        "tie_whole": text.fixed_point(eighth, 0, ties="up"),
        "large": text.fixed_point(10_000_000_000_000 + eighth, 2),
    }
    return logs(spark, sf_dir).select("event_id", *[c.alias(n) for n, c in shown.items()])


@query
def fn_iso_ts(spark, sf_dir):
    return logs(spark, sf_dir).select(
        "event_id",
        times.iso_format(F.col("ts")).alias("exact"),
        times.iso_format(F.date_trunc("second", "ts")).alias("whole"),
    )


@query
def fn_upper_severity(spark, sf_dir):
    return anomalies(spark, sf_dir).select(
        "id", context.shown_severity(F.col("severity")).alias("severity")
    )


@query
def fn_normalize_question(spark, sf_dir):
    spoken = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    padded = F.concat(F.lit(" \n\t"), "text", F.lit("  \r\n"))
    cleaned = text.normalize_question(
        F.when(F.col("role") == "system", F.lit(" \t ")).otherwise(padded)
    )
    return spoken.select("conv_id", "turn", cleaned.alias("question")).filter(
        F.col("question").isNotNull()
    )


# ---- contexts -----------------------------------------------------------------


def _contexts(spark, sf_dir) -> DataFrame:
    rolled = stored_buckets(spark, sf_dir)
    return questions.retrieve(asked(spark, sf_dir), anomalies_of(rolled), rolled, WIDTH_S)


@query
def ctx_retrieve(spark, sf_dir):
    """Sizes and totals of every retrieved context."""
    rows = _contexts(spark, sf_dir)
    events = F.aggregate(
        "service_stats", F.lit(0).cast("long"), lambda t, s: t + s["total_events"]
    )
    return rows.select(
        "question_id", "window_start", "window_end",
        F.size("anomalies").cast("long").alias("anomalies"),
        F.size("service_stats").cast("long").alias("services"),
        events.alias("events"),
    )


@query
def ctx_is_empty(spark, sf_dir):
    return _contexts(spark, sf_dir).select("question_id", context.is_empty().alias("is_empty"))


@query
def ctx_format(spark, sf_dir):
    return context.format_context(_contexts(spark, sf_dir)).select("question_id", "context")


@query
def ctx_prompt(spark, sf_dir):
    return context.prompts(_contexts(spark, sf_dir))


# ---- streams and refresh --------------------------------------------------------


def _event_stream(spark, sf_dir) -> DataFrame:
    static = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = (
        spark.readStream.schema(static.schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )
    return samples.events_as_logs(stream)


@query
def st_delivery(spark, sf_dir):
    """A batch that is delivered again after it was written: counts, and rows
    stored and set aside afterwards."""
    place = shared_dir(spark, "delivery")
    batch = messages(spark, sf_dir).select("value")
    for _ in range(2):
        counts = stream_ingest.ingest_batch(batch, 0, f"{place}/events", f"{place}/quarantine")
    stored = tables.EVENTS_TABLE.read(spark, f"{place}/events")
    rejected = spark.read.schema("raw string, reject_reason string").parquet(
        f"{place}/quarantine/*/*"
    )
    seen = [F.lit(counts[n]).cast("long").alias(n) for n in ("consumed", "accepted", "rejected")]
    return stored.agg(*seen, F.count("*").alias("stored")).withColumn(
        "set_aside", rejected.agg(F.count("*")).scalar()
    )


@query
def st_dedupe(spark, sf_dir):
    """All events through a stream of keyed inserts, started twice over."""
    path = shared_dir(spark, "deduped")

    def insert(batch: DataFrame, batch_id: int) -> None:
        tables.insert_events(samples.redelivered(batch), f"{path}/events")

    for run in ("first", "second"):
        _event_stream(spark, sf_dir).writeStream.foreachBatch(insert).option(
            "checkpointLocation", f"{path}/{run}"
        ).trigger(availableNow=True).start().awaitTermination()
    stored = tables.EVENTS_TABLE.read(spark, f"{path}/events")
    return stored.select("event_id", "ts", "service", "message")


HOURLY = rollup.RollupSettings(width_s=WIDTH_S, refresh_start_s=0)


@query
def st_rollup(spark, sf_dir):
    """Buckets closed by the streaming rollup: all but the ones still open."""
    path = shared_dir(spark, "rolled")
    stream_rollup.start_rollup(
        _event_stream(spark, sf_dir), f"{path}/rollup", f"{path}/checkpoint", HOURLY,
        available_now=True,
    ).awaitTermination()
    stored = tables.ROLLUP_TABLE.read(spark, f"{path}/rollup").drop("bucket_date")
    return rounded(stored, "avg_latency_ms", "p95_latency_ms")


def _rolled_stream(spark, sf_dir, path: str) -> DataFrame:
    tables.ROLLUP_TABLE.write(buckets(spark, sf_dir), f"{path}/rollup")
    return spark.readStream.schema(
        tables.with_partition(tables.ROLLUP, "bucket_date")
    ).parquet(f"{path}/rollup").drop("bucket_date")


@query
def st_detect(spark, sf_dir):
    """Anomalies found by the detection stream over the whole rollup table."""
    path = shared_dir(spark, "detected")
    stream = _rolled_stream(spark, sf_dir, path)
    stream_detect.start_detect(
        stream, f"{path}/rollup", f"{path}/anomalies", f"{path}/state", f"{path}/checkpoint",
        SETTINGS, available_now=True, detected_at=AS_OF,
    ).awaitTermination()
    stored = tables.ANOMALY_TABLE.read(spark, f"{path}/anomalies").drop("detected_date")
    return rounded(stored, *FOUND)


@query
def st_ewma_state(spark, sf_dir):
    """Baselines from keyed stream state over every reading."""
    path = shared_dir(spark, "baselines")
    readings = baseline.trailing_baseline(buckets(spark, sf_dir), SETTINGS)
    readings.filter("eligible and rate is not null").select(
        "service", "bucket", "rate"
    ).write.parquet(f"{path}/readings")
    stream = spark.readStream.schema("service string, bucket timestamp, rate double").parquet(
        f"{path}/readings"
    )
    stream_ewma.start_error_baselines(
        stream, f"{path}/state", f"{path}/out", f"{path}/checkpoint", SETTINGS, available_now=True
    ).awaitTermination()
    return rounded(spark.read.parquet(f"{path}/out").select(*refold.OUTPUT), "rate", "ewma")


@query
def st_ewma_late(spark, sf_dir):
    """Baselines over every reading when every fourth hour's come one batch after all others."""
    path = shared_dir(spark, "refolded")
    readings = baseline.trailing_baseline(buckets(spark, sf_dir), SETTINGS).filter("eligible and rate is not null")
    readings.select("service", "bucket", "rate").write.parquet(f"{path}/readings")
    stored = spark.read.schema("service string, bucket timestamp, rate double").parquet(f"{path}/readings")
    held = F.hour("bucket") % 4 == 3
    for batch_id, part in enumerate((~held, held)):
        stream_ewma.baseline_batch(stored.filter(part), batch_id, f"{path}/state", f"{path}/out", SETTINGS)
    return rounded(refold.current_baselines(spark, f"{path}/out"), "rate", "ewma")


@query
def st_detect_late(spark, sf_dir):
    """Current latency findings when every fourth hour's buckets come one batch after all others."""
    path = shared_dir(spark, "late")
    tables.ROLLUP_TABLE.write(buckets(spark, sf_dir), f"{path}/all")
    rolled = tables.ROLLUP_TABLE.read(spark, f"{path}/all").drop("bucket_date")
    held = F.hour("bucket") % 4 == 3
    for batch_id, part in enumerate((~held, held)):
        tables.ROLLUP_TABLE.write(rolled.filter(part), f"{path}/rollup")
        stream_detect.detect_batch(
            rolled.filter(part), batch_id, f"{path}/rollup", f"{path}/anomalies", f"{path}/state",
            SETTINGS, AS_OF,
        )
    found = tables.current_anomalies(spark, f"{path}/anomalies")
    return _found(found.filter(F.col("anomaly_type") != detect.ERROR_BURST).select(*detect.FINDING))


@query
def st_refresh_window(spark, sf_dir):
    """A stale table (no errors counted) after one refresh."""
    rolled = buckets(spark, sf_dir)
    stale = rolled.withColumn("error_count", F.lit(-1).cast("long"))
    fresh = rollup.refresh(
        stale, logs(spark, sf_dir), "2024-01-30 10:30:00", WIDTH_S, *REFRESH
    )
    return rounded(fresh, "avg_latency_ms", "p95_latency_ms")


@query
def st_backfill(spark, sf_dir):
    """The rollup table after late rows were filled in: a first rollup of the events that came
    within ten minutes, then all of them."""
    path = shared_dir(spark, "backfilled")
    delay = F.unix_seconds("ingested_at") - F.unix_seconds("ts")
    events = logs(spark, sf_dir)
    for part in (delay <= rollup.DEFAULTS.refresh_start_s, delay > rollup.DEFAULTS.refresh_start_s):
        tables.EVENTS_TABLE.write(events.filter(part), f"{path}/events")
        stream_rollup.backfill(
            spark, f"{path}/events", f"{path}/rollup", "2023-12-31 00:30:00", "2024-02-01 00:10:00", HOURLY
        )
    stored = tables.ROLLUP_TABLE.read(spark, f"{path}/rollup").drop("bucket_date")
    return rounded(stored, "avg_latency_ms", "p95_latency_ms")


@query
def st_late_data(spark, sf_dir):
    limit = rollup.DEFAULTS.refresh_start_s
    return rollup.late_arrivals(logs(spark, sf_dir), limit, WIDTH_S)


# ---- metric series ----------------------------------------------------------------


@query
def ts_rate(spark, sf_dir):
    rates = metrics.rate(
        counter(logs(spark, sf_dir)), ["service"], RATE_WINDOW_S, RATE_STEP_S, extrapolate=False
    )
    return rounded(rates, "rate")


@query
def ts_rate_extrapolated(spark, sf_dir):
    rates = metrics.rate(
        counter(logs(spark, sf_dir)), ["service"], RATE_WINDOW_S, RATE_STEP_S
    )
    return rounded(rates, "rate")


@query
def ts_sum(spark, sf_dir):
    rates = metrics.rate(
        counter(logs(spark, sf_dir)), ["service"], RATE_WINDOW_S, RATE_STEP_S
    )
    return rounded(metrics.sum_rates(rates, []), "rate")


def _severity_rates(spark, sf_dir) -> DataFrame:
    return anomaly_counter(anomalies(spark, sf_dir))


@query
def ts_sum_by(spark, sf_dir):
    rates = metrics.rate(
        _severity_rates(spark, sf_dir), ["service", "anomaly_type", "severity"], DAY, RATE_STEP_S
    )
    return rounded(metrics.sum_rates(rates, ["severity"]), "rate")


@query
def ts_histogram_quantile(spark, sf_dir):
    counted = metrics.histogram(
        logs(spark, sf_dir), ["service"], "latency_ms", LATENCY_BOUNDS
    )
    halves = metrics.histogram_quantile(counted, ["service"], 0.5, out="p50")
    tails = metrics.histogram_quantile(counted, ["service"], 0.95, out="p95")
    return rounded(halves.join(tails, "service"), "p50", "p95")


def _panel(title: str, legend: str) -> panels.Panel:
    return next(p for p in panels.PANELS if (p.title, p.legend) == (title, legend))


def _plotted(rows: DataFrame, labels: list[str], panel: panels.Panel, window_s: int) -> DataFrame:
    drawn = panels.plot(
        samples_of(rows, panel.metric, labels), panel, step_s=RATE_STEP_S, window_s=window_s
    )
    return rounded(drawn, "value")


@query
def ts_panels_sum(spark, sf_dir):
    panel = _panel("events ingested", "events written/s")
    return _plotted(counter(logs(spark, sf_dir)), ["service"], panel, RATE_WINDOW_S)


@query
def ts_panels_rate(spark, sf_dir):
    panel = _panel("questions", "questions/s")
    rows = _plotted(counter(logs(spark, sf_dir)), ["service"], panel, RATE_WINDOW_S)
    return rows.select("series", "ts", "value")


@query
def ts_panels_sum_by(spark, sf_dir):
    panel = _panel("anomalies detected", "by severity")
    labels = ["service", "anomaly_type", "severity"]
    return _plotted(_severity_rates(spark, sf_dir), labels, panel, DAY)


@query
def ts_panels_quantile(spark, sf_dir):
    panel = _panel("batch size", "p95")
    rows = latency_counter(logs(spark, sf_dir))
    return _plotted(rows, ["service", "le"], panel, DAY)


@query
def ts_panels_all(spark, sf_dir):
    """Panels of every shape from one pass over the samples of all their metrics."""
    counted = counter(logs(spark, sf_dir))
    written, asked = _panel("events ingested", "events written/s"), _panel("questions", "questions/s")
    low, high = _panel("batch size", "p50"), _panel("batch size", "p95")
    found = _panel("anomalies detected", "by severity")
    shown = [
        *[replace(p, window_s=RATE_WINDOW_S) for p in (written, asked)],
        *[replace(p, window_s=DAY) for p in (low, high, found)],
    ]
    samples = samples_of(latency_counter(logs(spark, sf_dir)), low.metric, ["service", "le"])
    for rows, metric, labels in (
        (counted, written.metric, ["service"]), (counted, asked.metric, ["service"]),
        (_severity_rates(spark, sf_dir), found.metric, ["service", "anomaly_type", "severity"]),
    ):
        samples = samples.unionByName(samples_of(rows, metric, labels))
    return rounded(panels.plot_all(samples, shown, step_s=RATE_STEP_S), "value")
