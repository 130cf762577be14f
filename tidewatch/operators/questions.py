"""Retrieval for many questions at once, without a range join.

A question asks for the newest anomalies, and for totals of the buckets, since a
moment of its own, for one service or for all. Both bounds are lower bounds on
the very column that orders the data, and that removes the range join:

* the newest 50 anomalies since t are the ones among the newest 50 overall that
  are not older than t, so one short list per service (and one for all services)
  serves every question;
* totals since t are suffix totals of two levels: of the buckets from t on in t's
  own time chunk, and of all later chunks. A chunk has a bounded number of buckets,
  a service has few chunks, and only chunks with buckets are stored rows.

A question then joins one row per side. Questions that name no service share
the NULL scope; that is a null-safe equality join, not a cross join. The earliest
moment that any question asks for is a subquery that prunes both tables before
they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ReadSettings
from ..functions.times import (
    bucket_index, first_index_from, lookback_hours, steps_down, window_start,
)
from ..schemas import CONTEXT_ANOMALIES, CONTEXT_ANOMALY, CONTEXT_STATS
from .filters import on_or_after
from .reads import TIES

READS = ReadSettings()
ASKED = ["question_id", "query", "service", "window_start", "window_end"]
# Buckets that one time chunk spans.
CHUNK = 1440


def with_window(questions: DataFrame, default_hours: int = READS.lookback_hours) -> DataFrame:
    """Questions with the bounds of their time window."""
    hours = lookback_hours(F.col("lookback_hours"), default_hours)
    return questions.select(
        "question_id", "query", "service",
        window_start(F.col("as_of"), hours).alias("window_start"),
        F.col("as_of").alias("window_end"),
    )


def newest_by_scope(anomalies: DataFrame, limit: int = READS.context_limit) -> DataFrame:
    """(scope, anomalies): the newest ``limit`` per service, and with a NULL
    scope the newest ``limit`` of all, as arrays in feed order."""
    order = [F.col("detected_at").desc(), *TIES]

    def first(rows: DataFrame, scope: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(scope).orderBy(*order))
        return rows.withColumn("_rank", rank).filter(F.col("_rank") <= limit)

    names = CONTEXT_ANOMALY.fieldNames()
    # The newest of all are among the newest of each service.
    scopes = F.explode(F.array("service", F.lit(None).cast("string")))
    scoped = first(anomalies.select(*names), "service").withColumn("scope", scopes)
    ranked = F.struct("_rank", F.struct(*names).alias("a"))
    return first(scoped, "scope").groupBy("scope").agg(
        F.sort_array(F.collect_list(ranked))["a"].alias("newest")
    )


def _earliest(asked: DataFrame) -> Column:
    """The first moment that any question asks for, known when the tables are read."""
    return asked.agg(F.min("window_start")).scalar()


def _attach_anomalies(asked: DataFrame, anomalies: DataFrame, limit: int) -> DataFrame:
    lists = newest_by_scope(on_or_after(anomalies, "detected_at", _earliest(asked)), limit)
    joined = asked.join(lists, asked["service"].eqNullSafe(lists["scope"]), "left")
    recent = F.filter("newest", lambda a: a["detected_at"] >= F.col("window_start"))
    return joined.withColumn(
        "anomalies", F.coalesce(recent, F.array().cast(CONTEXT_ANOMALIES))
    ).drop("scope", "newest")


def question_anomalies(
    questions: DataFrame, anomalies: DataFrame, limit: int = READS.context_limit
) -> DataFrame:
    """One row per question and retrieved anomaly; ``rank`` 1 is the newest."""
    found = _attach_anomalies(with_window(questions), anomalies, limit)
    names = [f.name for f in CONTEXT_ANOMALY.fields]
    return found.select("question_id", F.posexplode("anomalies").alias("_pos", "a")).select(
        "question_id", (F.col("_pos") + 1).alias("rank"), *[f"a.{n}" for n in names]
    )


def _totals(points: Column) -> Column:
    """Totals of an array of buckets, or of totals, in its order."""
    zero = F.struct(
        F.lit(0).cast("long").alias("buckets"), F.lit(0).cast("long").alias("events"),
        F.lit(0).cast("long").alias("errors"), F.lit(0.0).alias("p95_sum"),
        F.lit(0).cast("long").alias("p95_count"), F.lit(None).cast("double").alias("peak"),
    )
    sums = ["buckets", "events", "errors", "p95_sum", "p95_count"]
    return F.aggregate(points, zero, lambda t, p: F.struct(
        *[(t[n] + F.coalesce(p[n], F.lit(0))).alias(n) for n in sums],
        F.greatest(t["peak"], p["peak"]).alias("peak"),
    ))


def bucket_chunks(buckets: DataFrame, width_s: int) -> DataFrame:
    """(service, chunk, points): the buckets of each time chunk that has any, in order."""
    number = bucket_index(F.col("bucket"), width_s)
    p95 = F.col("p95_latency_ms")
    point = F.struct(
        number.alias("number"), F.lit(1).cast("long").alias("buckets"),
        F.col("event_count").alias("events"), F.col("error_count").alias("errors"),
        p95.alias("p95_sum"), p95.isNotNull().cast("long").alias("p95_count"),
        F.col("max_latency_ms").alias("peak"),
    )
    # Without nulls, no reader adds a filter of its own, and all of them share one scan.
    chunk = F.coalesce(steps_down(number, CHUNK), F.lit(0).cast("long"))
    return (
        buckets.filter(F.col("service").isNotNull() & F.col("bucket").isNotNull())
        .select("service", chunk.alias("chunk"), point.alias("point"))
        .groupBy("service", "chunk").agg(F.sort_array(F.collect_list("point")).alias("points"))
    )


def _with_start(asked: DataFrame, width_s: int) -> DataFrame:
    """Questions with ``start``, the number of the first bucket in their window."""
    return asked.withColumn("start", first_index_from(F.col("window_start"), width_s))


def stats_by_scope(asked: DataFrame, buckets: DataFrame, width_s: int) -> DataFrame:
    """(scope, start, stats) for the starts that questions need.

    Per service and start: totals from the start on within its chunk, plus the totals of the
    later chunks. Questions without a service get the services that have a
    bucket in a later chunk or in their own; a start and a service meet by the number of the chunk.
    """
    chunks = bucket_chunks(buckets, width_s)
    entry = F.struct("chunk", _totals(F.col("points")).alias("t"))
    series = chunks.groupBy("service").agg(F.sort_array(F.collect_list(entry)).alias("series"))
    wanted = asked.select("service", "start", steps_down(F.col("start"), CHUNK).alias("chunk"))
    named = wanted.filter(F.col("service").isNotNull()).distinct()
    anywhere = wanted.filter(F.col("service").isNull()).select("start", "chunk").distinct()
    asked_chunks = anywhere.agg(F.collect_set("chunk")).scalar()
    last = F.element_at("series", -1)["chunk"]
    open_chunks = series.withColumn("chunk", F.explode(asked_chunks)).filter(F.col("chunk") <= last)
    points = named.join(series, "service").withColumn("scope", F.col("service")).unionByName(
        anywhere.join(open_chunks, "chunk").withColumn("scope", F.lit(None).cast("string"))
    )
    later = F.filter("series", lambda e: e["chunk"] > F.col("chunk"))
    after = _totals(F.transform(later, lambda e: e["t"]))
    met = points.withColumn("after", after).drop("series").join(chunks, ["service", "chunk"], "left")
    inside = _totals(F.filter("points", lambda p: p["number"] >= F.col("start")))
    total = F.when(F.col("points").isNull(), F.col("after")).otherwise(
        _totals(F.array(inside, F.col("after")))
    )
    found = met.select("scope", "start", "service", total.alias("t")).filter("t.buckets > 0")
    one = F.struct(
        "service", F.col("t.events").alias("total_events"), F.col("t.errors").alias("total_errors"),
        F.when(F.col("t.p95_count") > 0, F.col("t.p95_sum") / F.col("t.p95_count")).alias(
            "avg_p95_latency_ms"),
        F.col("t.peak").alias("max_latency_ms"),
    )
    return found.groupBy("scope", "start").agg(F.sort_array(F.collect_list(one)).alias("stats"))


def _attach_stats(asked: DataFrame, buckets: DataFrame, width_s: int) -> DataFrame:
    started = _with_start(asked, width_s)
    lists = stats_by_scope(started, on_or_after(buckets, "bucket", _earliest(asked)), width_s)
    lists = lists.withColumnRenamed("start", "_start")
    same = started["service"].eqNullSafe(lists["scope"]) & (started["start"] == lists["_start"])
    return (
        started.join(lists, same, "left")
        .withColumn("service_stats", F.coalesce("stats", F.array().cast(CONTEXT_STATS)))
        .drop("scope", "_start", "start", "stats")
    )


def question_stats(questions: DataFrame, buckets: DataFrame, width_s: int) -> DataFrame:
    """One row per question and service with buckets in the question's window."""
    found = _attach_stats(with_window(questions), buckets, width_s)
    return found.select("question_id", F.inline("service_stats"))


def retrieve(
    questions: DataFrame, anomalies: DataFrame, buckets: DataFrame, width_s: int,
    limit: int = READS.context_limit,
) -> DataFrame:
    """One row per question: its window, anomalies and service totals."""
    found = _attach_stats(_attach_anomalies(with_window(questions), anomalies, limit), buckets, width_s)
    return found.select(*ASKED, "anomalies", "service_stats")
