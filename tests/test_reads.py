from __future__ import annotations

from datetime import timedelta

import pytest
from helpers import START, bucket_row, buckets, utc
from pyspark.sql import functions as F

from tidewatch import schemas
from tidewatch.operators import context, questions, reads
from tidewatch.sources import tables

NOW = utc(2026, 7, 22, 12)


def anomaly(i, back_min, service="payments", kind="error_burst", severity="warning"):
    at = NOW - timedelta(minutes=back_min)
    return (f"id{i}", at, at - timedelta(minutes=2), service, kind, 0.5, 0.12, 0.0, 3.29, severity)


def anomalies(spark, rows):
    return spark.createDataFrame(rows, schemas.ANOMALIES)


def asked(spark, rows):
    return spark.createDataFrame(rows, schemas.QUESTIONS)


def test_feed_bound_is_inclusive_and_order_complete(spark):
    rows = [anomaly(i, m, s) for i, (m, s) in enumerate(
        [(0, "b"), (0, "a"), (60, "a"), (61, "a"), (24 * 60, "z"), (24 * 60 + 1, "z")])]
    feed = reads.anomaly_feed(anomalies(spark, rows), NOW)
    assert [r.id for r in feed.collect()] == ["id1", "id0", "id2", "id3", "id4"]
    assert [r.id for r in reads.anomaly_feed(anomalies(spark, rows), NOW, 1, 2).collect()] == ["id1", "id0"]
    assert feed.columns == schemas.ANOMALIES.fieldNames()


def test_context_anomalies_for_one_service(spark):
    rows = [anomaly(1, 5), anomaly(2, 5, "auth"), anomaly(3, 500)]
    got = reads.context_anomalies(anomalies(spark, rows), NOW, service="payments")
    assert got.count() == 1 and "id" not in got.columns and "baseline_stddev" not in got.columns


def test_health(spark):
    stats = spark.createDataFrame(
        [("checkout", 200, 20, 150.5, 300.25), ("idle-service", 0, 0, None, None), ("a", 100, 50, 1.0, 2.0),
         ("b", 12345, 100, 1.0, 2.0)], schemas.SERVICE_STATS)
    health = reads.with_health(stats)
    rates = {r.service: r.error_rate for r in health.collect()}
    assert rates == {"checkout": 0.1, "idle-service": 0.0, "a": 0.5, "b": pytest.approx(100 / 12345)}
    cards = {r.service: tuple(r)[1:] for r in reads.health_cards(health).collect()}
    assert cards["checkout"] == ("warning", "200", "10.0%", "151ms", "300ms")
    assert cards["idle-service"] == ("healthy", "0", "0.0%", "—", "—")
    assert cards["b"][1] == "12,345" and cards["a"][0] == "critical"


def test_feed_line(spark):
    line = reads.feed_lines(anomalies(spark, [anomaly(1, 90)]), str(NOW.replace(tzinfo=None))).first().line
    assert line == "1h ago warning payments · error_burst · value=0.50 baseline=0.12 z=3.29"


def test_context_texts(spark):
    empty = spark.createDataFrame(
        [(NOW - timedelta(hours=6), NOW, [], [])],
        "window_start timestamp, window_end timestamp, "
        f"anomalies {schemas.CONTEXT_ANOMALIES.simpleString()}, "
        f"service_stats {schemas.CONTEXT_STATS.simpleString()}")
    row = empty.select(context.context_text().alias("t"), context.is_empty().alias("e")).first()
    assert row.e
    assert row.t == ("Time window: 2026-07-22T06:00:00+00:00 to 2026-07-22T12:00:00+00:00\n\n"
                     "No anomalies detected in this window.")
    stats = [("checkout", 200, 20, 150.0, 300.0), ("idle-service", 0, 0, None, None)]
    found = [(NOW, NOW - timedelta(minutes=2), "payments", "error_burst", 0.5, 0.12, 3.29, "warning")]
    full = spark.createDataFrame([(NOW - timedelta(hours=6), NOW, found, stats)], empty.schema)
    row = full.select(context.context_text().alias("t"), context.is_empty().alias("e")).first()
    assert not row.e
    assert row.t.split("\n")[2:] == [
        "Service stats:",
        "- checkout: 200 events, 10.0% error rate, avg p95 latency 150ms, max latency 300ms",
        "- idle-service: 0 events, 0.0% error rate, avg p95 latency 0ms, max latency 0ms",
        "",
        "Detected anomalies (most recent first):",
        "- [WARNING] payments at 2026-07-22T11:58:00+00:00: error_burst, value=0.50, baseline=0.12,"
        " z_score=3.29",
    ]


def question_set(spark):
    rows, n = [], 0
    for service in (None, "checkout", "auth", "nobody"):
        for hours in (None, 0, 1, 2, 5, 9000):
            for shift in (0, 7, 31):
                n += 1
                as_of = START + timedelta(hours=3, minutes=shift, seconds=shift, microseconds=shift)
                rows.append((n, f" q{n} ", service, hours, as_of))
    return rows


def many_buckets():
    """Two services with gaps; one starts late and ends early."""
    rows = [bucket_row(i, 10.0 + i, 20.0 + i, i % 3, 5 + i % 7) for i in range(0, 240, 3)]
    rows += [bucket_row(i, 1.0 * i, 2.0 * i, 1, 2, "auth") for i in range(100, 150)]
    return rows


def test_question_stats_equal_a_range_join(spark):
    rolled = buckets(spark, many_buckets())
    qs = asked(spark, question_set(spark))
    got = questions.question_stats(qs, rolled, 60)
    windows = questions.with_window(qs).withColumnRenamed("service", "wanted")
    want = windows.join(
        rolled, (F.col("bucket") >= F.col("window_start"))
        & (F.col("wanted").isNull() | (F.col("service") == F.col("wanted")))
    ).groupBy("question_id", "service").agg(
        F.sum("event_count").alias("total_events"), F.sum("error_count").alias("total_errors"),
        F.avg("p95_latency_ms").alias("avg_p95_latency_ms"), F.max("max_latency_ms").alias("max_latency_ms"))
    names = ["question_id", "service", "total_events", "total_errors", "max_latency_ms"]
    key = {tuple(r)[:2]: tuple(r)[2:] for r in got.select(*names, F.round("avg_p95_latency_ms", 9)).collect()}
    expected = {tuple(r)[:2]: tuple(r)[2:] for r in want.select(*names, F.round("avg_p95_latency_ms", 9)).collect()}
    assert key == expected and len(key) > 40


@pytest.mark.parametrize("limit", [3, 50])
def test_question_anomalies_equal_a_range_join(spark, limit):
    rows = [anomaly(i, i * 3, s, k) for i in range(60) for s in ("checkout", "auth") for k in ("a", "b")]
    shifted = [(f"{n}", *r[1:]) for n, r in enumerate(rows)]
    table = anomalies(spark, shifted).withColumn("detected_at", F.expr("detected_at - interval 46 hours"))
    qs = asked(spark, question_set(spark))
    got = {tuple(r) for r in questions.question_anomalies(qs, table, limit).select(
        "question_id", "rank", "service", "anomaly_type", F.unix_seconds("detected_at")).collect()}
    found = [(r.service, r.anomaly_type, r.t, r.bucket_ts) for r in table.withColumn(
        "t", F.unix_seconds("detected_at")).collect()]
    want = set()
    for q in questions.with_window(qs).withColumn("w", F.unix_micros("window_start")).collect():
        mine = [f for f in found if f[2] * 10**6 >= q.w and q.service in (None, f[0])]
        mine.sort(key=lambda f: (-f[2], f[0], f[1], f[3]))
        want |= {(q.question_id, i + 1, f[0], f[1], f[2]) for i, f in enumerate(mine[:limit])}
    assert got == want and want


def test_retrieve_keeps_every_question(spark):
    qs = asked(spark, question_set(spark))
    rolled, none = buckets(spark, many_buckets()), anomalies(spark, [])
    rows = questions.retrieve(qs, none, rolled, 60)
    assert rows.count() == len(question_set(spark))
    nobody = rows.filter("service = 'nobody'").select(context.is_empty().alias("e"))
    assert {r.e for r in nobody.collect()} == {True}
    prompt = context.prompts(rows).filter("question_id = 1").first().prompt
    assert prompt.startswith("Time window: ") and prompt.endswith("\n\nQuestion: q1\n\nAnswer:")


def test_blank_questions_are_not_asked(spark):
    qs = asked(spark, [(1, " \n ", None, None, START), (2, "why", None, None, START)])
    rows = questions.retrieve(qs, anomalies(spark, []), buckets(spark, many_buckets()), 60)
    assert [r.question_id for r in context.prompts(rows).collect()] == [2]


def test_no_cross_or_nested_loop_join(spark):
    qs = asked(spark, question_set(spark))
    rolled = buckets(spark, many_buckets())
    rows = questions.retrieve(qs, anomalies(spark, [anomaly(1, 5)]), rolled, 60)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def scans(df):
    """Filters of the file scans of a plan that has run; a result that is used again is not entered."""

    def under(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return under(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return under(node.plan())
        if kind == "ReusedExchangeExec":
            return []
        if kind == "FileSourceScanExec":
            return [node.partitionFilters().mkString(" ")]
        children = node.children()
        return [f for i in range(children.size()) for f in under(children.apply(i))]

    df.collect()
    return under(df._jdf.queryExecution().executedPlan())


def test_question_tables_are_read_once_from_the_earliest_window_on(spark, tmp_path):
    days = (-400, -3, 0)
    tables.ROLLUP_TABLE.write(buckets(spark, [bucket_row(1440 * d, 10.0, 20.0) for d in days]), f"{tmp_path}/r")
    tables.insert_anomalies(anomalies(spark, [anomaly(i, -1440 * d) for i, d in enumerate(days)]), f"{tmp_path}/a")
    rolled = tables.ROLLUP_TABLE.read(spark, f"{tmp_path}/r")
    found = tables.ANOMALY_TABLE.read(spark, f"{tmp_path}/a")
    qs = asked(spark, [(1, "a", None, 96, START), (2, "b", "checkout", None, START)])
    rows = questions.retrieve(qs, found, rolled, 60)
    read = scans(rows)
    assert len(read) == 2 and all("_date" in f and ">= to_date" in f.replace("cast", "to_date") for f in read), read
    got = {r.question_id: (len(r.anomalies), r.service_stats[0].total_events) for r in rows.collect()}
    assert got == {1: (2, 200), 2: (0, 100)}


def test_buckets_far_apart_stay_two_rows(spark):
    year = 365 * 1440
    rolled = buckets(spark, [bucket_row(0, 1.0, 2.0), bucket_row(year, 3.0, 4.0)])
    assert questions.bucket_chunks(rolled, 60).count() == 2
    late = [(i, "q", s, h, START + timedelta(days=366)) for i, (s, h) in enumerate(
        [("checkout", 24 * 366), ("checkout", 24 * 30), (None, 24 * 30), (None, 24 * 400), (None, 1)])]
    got = {r.question_id: (r.total_events, r.avg_p95_latency_ms) for r in questions.question_stats(asked(spark, late), rolled, 60).collect()}
    assert got == {0: (200, 2.0), 1: (100, 3.0), 2: (100, 3.0), 3: (200, 2.0)}


@pytest.mark.parametrize("chunk", [1, 7, 100])
def test_stats_for_any_chunk(spark, monkeypatch, chunk):
    monkeypatch.setattr(questions, "CHUNK", chunk)
    test_question_stats_equal_a_range_join(spark)


def test_reads_of_stored_tables_prune_by_date(spark, tmp_path):
    tables.ROLLUP_TABLE.write(buckets(spark, [bucket_row(m, 10.0, 20.0) for m in (-3 * 1440, 0, 10)]), f"{tmp_path}/r")
    tables.insert_anomalies(anomalies(spark, [anomaly(i, m) for i, m in enumerate((1, 5000))]), f"{tmp_path}/a")
    rolled = tables.ROLLUP_TABLE.read(spark, f"{tmp_path}/r")
    found = tables.ANOMALY_TABLE.read(spark, f"{tmp_path}/a")
    frames = [
        reads.recent_buckets(rolled, START, 3600), reads.service_health(rolled, START), reads.context_stats(rolled, START),
        reads.anomaly_feed(found, NOW), reads.context_anomalies(found, NOW),
    ]
    for frame in frames:
        plan = frame._jdf.queryExecution().simpleString()
        assert "PartitionFilters: [isnotnull(" in plan
    assert frames[0].count() == 2 and frames[3].count() == 1
