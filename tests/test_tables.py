from __future__ import annotations

from datetime import timedelta

from helpers import START, as_set, bucket_row, buckets, event, events
from pyspark.sql import functions as F

from tidewatch import schemas
from tidewatch.operators import filters
from tidewatch.sources import kafka, tables


def test_insert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = [event(i, START + timedelta(hours=i)) for i in range(40)]
    tables.insert_events(events(spark, rows + rows), path)
    tables.insert_events(events(spark, rows), path)
    changed = event(3, START + timedelta(hours=3), message="changed")
    tables.insert_events(events(spark, [changed, event(99, START)]), path)
    stored = tables.EVENTS_TABLE.read(spark, path)
    assert stored.count() == 41
    assert as_set(stored, "message") == {("handled",)}


def test_empty_insert(spark, tmp_path):
    path = str(tmp_path / "events")
    tables.insert_events(events(spark, []), path)
    assert tables.EVENTS_TABLE.read(spark, path).count() == 0


def test_only_touched_dates_are_read(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = [event(i, START + timedelta(days=i)) for i in range(5)]
    tables.insert_events(events(spark, rows), path)
    stored = tables.EVENTS_TABLE.read(spark, path)
    touched = tables.EVENTS_TABLE.touched(stored, events(spark, rows[1:2]))
    assert touched.count() == 1
    plan = touched._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert "GreaterThanOrEqual(ts" in plan.split("PushedFilters: ")[1].split("]")[0]


def test_many_dates_become_a_range(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "MAX_LISTED_DATES", 2)
    path = str(tmp_path / "events")
    rows = [event(i, START + timedelta(days=i)) for i in range(6)]
    for _ in range(2):
        tables.insert_events(events(spark, rows), path)
    assert tables.EVENTS_TABLE.read(spark, path).count() == 6


def test_lookback_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "events")
    tables.EVENTS_TABLE.write(events(spark, [event(i, START + timedelta(days=i)) for i in range(5)]), path)
    recent = filters.since(tables.EVENTS_TABLE.read(spark, path), "ts", START + timedelta(days=5), 2 * 86400)
    assert recent.count() == 2
    plan = recent._jdf.queryExecution().executedPlan().toString()
    filters_part = plan.split("PartitionFilters: ")[1].split("]")[0]
    assert "event_date" in filters_part
    assert "ts" in plan.split("PushedFilters: ")[1].split("]")[0]


def test_writes_rebalance_hot_dates(spark):
    df = events(spark, [event(1, START)]).withColumn("event_date", F.to_date("ts"))
    plan = df.hint("rebalance", "event_date")._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions" in plan


def test_replace_touches_only_same_keys(spark, tmp_path):
    path = str(tmp_path / "rollup")
    tables.ROLLUP_TABLE.write(buckets(spark, [bucket_row(i, 1.0, 1.0) for i in range(0, 3000, 500)]), path)
    tables.ROLLUP_TABLE.replace(buckets(spark, [bucket_row(500, 2.0, 2.0), bucket_row(501, 3.0, 3.0)]), path)
    stored = tables.ROLLUP_TABLE.read(spark, path)
    assert sorted(r.p95_latency_ms for r in stored.collect()) == [1.0] * 5 + [2.0, 3.0]
    tables.ROLLUP_TABLE.replace(buckets(spark, []), path)
    assert tables.ROLLUP_TABLE.read(spark, path).count() == 7


def test_anomaly_insert_is_idempotent_across_detection_days(spark, tmp_path):
    path = str(tmp_path / "anomalies")
    row = ("id1", START, START - timedelta(hours=1), "s", "error_burst", 1.0, 1.0, 0.0, 3.0, "warning")
    for day in range(3):
        df = spark.createDataFrame([(row[0], START + timedelta(days=day), *row[2:])], schemas.ANOMALIES)
        tables.insert_anomalies(df, path)
    stored = tables.ANOMALY_TABLE.read(spark, path)
    assert [r.detected_date.day for r in stored.collect()] == [START.day]


def test_kafka_records(spark):
    df = events(spark, [event(1, START, "auth", latency=12.5)])
    row = kafka.records(df).first()
    assert bytes(row.key) == b"auth"
    assert bytes(row.value).decode() == (
        '{"event_id":"00000000-0000-4000-8000-000000000001","timestamp":"2026-07-20T12:00:00+00:00",'
        '"service":"auth","endpoint":"/auth","level":"INFO","status_code":200,"latency_ms":12.5,'
        '"message":"handled","trace_id":"00000000-0000-4000-8000-000001000001","anomaly_injected":false}')


def test_kafka_reader_options():
    options = kafka.reader_options("broker:9092", max_per_trigger=1000)
    assert options["subscribe"] == "service-logs" and options["startingOffsets"] == "latest"
    assert options["minOffsetsPerTrigger"] == "100" and options["maxTriggerDelay"] == "500ms"
    assert kafka.reader_options("broker:9092")["maxOffsetsPerTrigger"] == "1000000"
    assert kafka.reader_options("broker:9092", max_per_trigger=5)["maxOffsetsPerTrigger"] == "100"
    assert options["maxOffsetsPerTrigger"] == "1000" and options["kafka.fetch.max.bytes"] == "10000000"
