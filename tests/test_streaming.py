from __future__ import annotations

import json
import random
from datetime import timedelta

import pytest
from helpers import START, as_set, bucket_row, buckets, event, events, uuid
from pyspark.sql import functions as F
from test_detect import noisy

from tidewatch import schemas
from tidewatch.config import DetectSettings, IngestSettings, RollupSettings
from tidewatch.operators import decode, detect, rollup
from tidewatch.sources import tables
from tidewatch.plans import panels
from tidewatch.streaming import counters
from tidewatch.streaming import detect as stream_detect
from tidewatch.streaming import ewma as stream_ewma
from tidewatch.streaming import refold
from tidewatch.streaming import ingest
from tidewatch.streaming import rollup as stream_rollup


def message(number, **other):
    row = {
        "event_id": uuid(number), "timestamp": "2026-07-20T16:30:11.5Z", "service": "checkout",
        "endpoint": "/x", "level": "INFO", "status_code": 200, "latency_ms": 1.5, "message": "m",
        "trace_id": uuid(7), "anomaly_injected": False,
    }
    return json.dumps(row | other)


def put(spark, path, texts):
    spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.mode("append").text(path)


def topic(spark, path):
    return spark.readStream.option("maxFilesPerTrigger", 1).text(path)


class Places:
    def __init__(self, root):
        self.topic, self.events = f"{root}/topic", f"{root}/events"
        self.quarantine, self.checkpoint = f"{root}/quarantine", f"{root}/checkpoint"

    def run(self, spark):
        ingest.start_ingest(
            topic(spark, self.topic), self.events, self.quarantine, self.checkpoint, available_now=True
        ).awaitTermination()

    def stored(self, spark):
        return tables.EVENTS_TABLE.read(spark, self.events)

    def rejected(self, spark):
        return spark.read.schema("raw string, reject_reason string").parquet(f"{self.quarantine}/*/*")


def test_ingest_over_batches_restarts_and_copies(spark, tmp_path):
    p = Places(tmp_path)
    put(spark, p.topic, [message(1), message(2), message(2), "junk"])
    put(spark, p.topic, [message(2), message(3), message(4, timestamp="yesterday")])
    p.run(spark)
    assert as_set(p.stored(spark), "event_id") == {(uuid(i),) for i in (1, 2, 3)}
    put(spark, p.topic, [message(1), message(5), message(6, trace_id="x")])
    p.run(spark)
    assert as_set(p.stored(spark), "event_id") == {(uuid(i),) for i in (1, 2, 3, 5)}
    assert p.stored(spark).count() == 4
    assert sorted(r.reject_reason for r in p.rejected(spark).collect()) == sorted(
        [decode.BAD_JSON, decode.BAD_TIMESTAMP, "trace_id is not a uuid"])


def test_failed_batch_is_repeated_without_duplicates(spark, tmp_path, monkeypatch):
    p = Places(tmp_path)
    put(spark, p.topic, [message(i) for i in range(20)] + ["junk"])
    real = ingest.quarantined

    def broken(classified):
        raise RuntimeError("lost after the events were written")

    monkeypatch.setattr(ingest, "quarantined", broken)
    with pytest.raises(Exception):
        p.run(spark)
    assert p.stored(spark).count() == 20
    monkeypatch.setattr(ingest, "quarantined", real)
    p.run(spark)
    assert p.stored(spark).count() == 20
    assert p.rejected(spark).count() == 1


def test_counts_of_a_batch(spark, tmp_path):
    df = spark.createDataFrame([(t,) for t in (message(1), message(1), "junk")], "value string")
    counts = ingest.ingest_batch(df, 0, f"{tmp_path}/e", f"{tmp_path}/q")
    assert counts == {"consumed": 3, "accepted": 2, "rejected": 1}


def test_arrival_order_of_a_topic(spark, tmp_path):
    rows = [(message(1, message="late"), 5, 9), (message(1, message="early"), 5, 2)]
    df = spark.createDataFrame(rows, "value string, partition int, offset long")
    ingest.ingest_batch(df, 0, f"{tmp_path}/e", f"{tmp_path}/q")
    assert as_set(tables.EVENTS_TABLE.read(spark, f"{tmp_path}/e"), "message") == {("early",)}


def event_files(spark, path, batches):
    for rows in batches:
        events(spark, rows).coalesce(1).write.mode("append").parquet(path)


def event_stream(spark, path):
    return spark.readStream.schema(schemas.LOG_EVENTS).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_rollup_equals_batch_on_closed_buckets(spark, tmp_path):
    rows = [
        event(i, START + timedelta(seconds=7 * i), "auth" if i % 3 else "checkout",
              "ERROR" if i % 5 == 0 else "INFO", (i * 37) % 101)
        for i in range(600)]
    path = f"{tmp_path}/in"
    event_files(spark, path, [rows[:200], rows[200:400], rows[400:]])
    settings = RollupSettings(refresh_start_s=60, hot_rows=3)
    for _ in range(2):
        stream_rollup.start_rollup(
            event_stream(spark, path), f"{tmp_path}/rollup", f"{tmp_path}/cp", settings,
            available_now=True).awaitTermination()
    names = [n for n in schemas.ROLLUP.fieldNames() if n != "avg_latency_ms"]
    got = tables.ROLLUP_TABLE.read(spark, f"{tmp_path}/rollup").withColumn(
        "avg_latency_ms", F.round("avg_latency_ms", 9))
    closed = max(r["ts"] for r in rows) - timedelta(seconds=60)
    want = rollup.rollup(events(spark, rows)).filter(
        F.expr("bucket + interval 1 minute") <= F.lit(closed).cast("timestamp")
    ).withColumn("avg_latency_ms", F.round("avg_latency_ms", 9))
    assert as_set(got, *names, "avg_latency_ms") == as_set(want, *names, "avg_latency_ms")
    assert got.count() == want.count() > 100


def test_refresh_table_and_backfill(spark, tmp_path):
    ep, rp = f"{tmp_path}/events", f"{tmp_path}/rollup"
    rows = [event(i, START + timedelta(minutes=i)) for i in range(30)]
    tables.insert_events(events(spark, rows), ep)
    for minute in range(3, 30, 3):
        stream_rollup.refresh_table(spark, ep, rp, START + timedelta(minutes=minute))
    counts = {r.m: r.n for r in tables.ROLLUP_TABLE.read(spark, rp).select(
        F.minute("bucket").alias("m"), F.col("event_count").alias("n")).collect()}
    assert counts == {m: 1 for m in range(26)}
    # A row that is too late reaches the events, not its bucket.
    tables.insert_events(events(spark, [event(500, START + timedelta(minutes=2, seconds=5))]), ep)
    stream_rollup.refresh_table(spark, ep, rp, START + timedelta(minutes=29))
    third = F.col("bucket") == F.lit(START + timedelta(minutes=2)).cast("timestamp")
    assert tables.ROLLUP_TABLE.read(spark, rp).filter(third).first().event_count == 1
    stream_rollup.backfill(spark, ep, rp, START, START + timedelta(minutes=10))
    assert tables.ROLLUP_TABLE.read(spark, rp).filter(third).first().event_count == 2
    assert tables.ROLLUP_TABLE.read(spark, rp).count() == 28


def test_backfill_between_edges_equals_rollup(spark, tmp_path):
    ep, rp = f"{tmp_path}/events", f"{tmp_path}/rollup"
    rows = [event(i, START + timedelta(seconds=10 * i)) for i in range(18)]
    tables.insert_events(events(spark, rows), ep)
    stream_rollup.backfill(spark, ep, rp, START, START + timedelta(minutes=3))
    stream_rollup.backfill(spark, ep, rp, START + timedelta(seconds=30), START + timedelta(seconds=90))
    stored = tables.ROLLUP_TABLE.read(spark, rp)
    assert as_set(stored, "bucket", "event_count") == as_set(rollup.rollup(events(spark, rows)), "bucket", "event_count")
    assert {r.event_count for r in stored.collect()} == {6}


def test_shared_folder_needs_a_setting_on_a_cluster():
    from types import SimpleNamespace

    from tidewatch.session import shared_dir

    def fake(master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))

    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(ValueError):
            shared_dir(fake(master), "x")
    assert shared_dir(fake("local[2]"), "x").startswith("file:/")


def test_shared_folder_names_its_file_system(spark):
    from tidewatch.session import qualified, shared_dir

    assert shared_dir(spark, "x").startswith("file:/")
    assert qualified(spark, "file:///a/b") == "file:/a/b" and qualified(spark, "/a/b") == "file:/a/b"


def bucket_files(spark, path, rows, cuts):
    edges = [START + timedelta(minutes=m) for m in (-1, *cuts, 10**4)]
    for a, b in zip(edges, edges[1:]):
        part = [r for r in rows if a <= r[0] < b]
        buckets(spark, part).coalesce(1).write.mode("append").parquet(path)


def test_stream_detection_equals_replay(spark, tmp_path):
    rows, s = noisy(300), DetectSettings()
    path, table = f"{tmp_path}/in", f"{tmp_path}/rollup"
    bucket_files(spark, path, rows, (90, 170, 230))
    tables.ROLLUP_TABLE.write(buckets(spark, rows), table)
    stream = spark.readStream.schema(schemas.ROLLUP).option("maxFilesPerTrigger", 1).parquet(path)
    stream_detect.start_detect(
        stream, table, f"{tmp_path}/anomalies", f"{tmp_path}/state", f"{tmp_path}/cp", s,
        available_now=True).awaitTermination()
    got = tables.ANOMALY_TABLE.read(spark, f"{tmp_path}/anomalies")
    want = detect.as_records(detect.detect(buckets(spark, rows), s), START)
    assert as_set(got, "id", "severity") == as_set(want, "id", "severity")
    assert got.count() == want.count() > 10
    # Repeating a batch changes nothing.
    last = buckets(spark, [r for r in rows if r[0] >= START + timedelta(minutes=230)])
    stream_detect.detect_batch(last, 3, table, f"{tmp_path}/anomalies", f"{tmp_path}/state", s)
    assert tables.ANOMALY_TABLE.read(spark, f"{tmp_path}/anomalies").count() == want.count()


def test_state_baseline_equals_batch_over_restarts(spark, tmp_path):
    rows, s = noisy(200), DetectSettings()
    scored = detect.score(buckets(spark, rows), s).filter("ewma is not null")
    readings = scored.select("service", "bucket", "rate")
    path = f"{tmp_path}/in"
    cut = F.lit(START + timedelta(minutes=100)).cast("timestamp")
    for part in (F.col("bucket") < cut, F.col("bucket") >= cut):
        readings.filter(part).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(readings.schema).parquet(path)
        stream_ewma.start_error_baselines(
            stream, f"{tmp_path}/state", f"{tmp_path}/out", f"{tmp_path}/cp", s, available_now=True,
        ).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select(*refold.OUTPUT)
    both = got.select("service", "bucket", F.col("ewma").alias("g")).join(scored, ["service", "bucket"])
    assert got.count() == both.count() == scored.count()
    assert both.agg(F.max(F.abs(F.col("g") - F.col("ewma")))).first()[0] < 1e-9


def test_late_readings_move_baselines(spark, tmp_path):
    rng, s = random.Random(20), DetectSettings(chunk_buckets=20, window_s=600)
    rows = [(n, START + timedelta(minutes=m), rng.random()) for n in ("auth", "cart", "web") for m in range(150) if rng.random() < 0.7]
    parts = [[] for _ in range(4)]
    for r in rows:  # web's oldest readings, and many others, come last
        parts[3 if r[0] == "web" and r[1] < START + timedelta(minutes=45) else rng.choice([0, 0, 0, 1, 2])].append(r)
    again = parts[0][:5] + parts[1][:1]
    state, out = f"{tmp_path}/s", f"{tmp_path}/o"
    for batch_id, part in enumerate([*parts, again, []]):
        df = spark.createDataFrame(part, "service string, bucket timestamp, rate double")
        for _ in range(2 if batch_id % 2 else 1):  # a repeated batch changes nothing
            stream_ewma.baseline_batch(df, batch_id, state, out, s)
    want, b = {}, {}
    for n, t, x in sorted(rows):
        want[n, t.replace(tzinfo=None)] = b.get(n, x)
        b[n] = s.ewma_alpha * x + (1 - s.ewma_alpha) * b.get(n, x)
    got = {(r.service, r.bucket): r.ewma for r in refold.current_baselines(spark, out).collect()}
    assert got == pytest.approx(want, abs=1e-9) and len(got) == len(rows)
    assert refold.repeats(spark, state).agg(F.sum("repeats")).first()[0] == 6
    # readings sent again, and a batch without any, write no version
    assert spark.read.schema(refold.VERSIONS).parquet(out).filter("batch >= 4").count() == 0


def test_late_bucket_is_judged_and_its_reading_counted(spark, tmp_path):
    s = DetectSettings()
    rows = [bucket_row(m, 5000.0 if m == 30 else 100.0 + m % 5, 200.0 + m % 7) for m in range(40)]
    table, found, state = (f"{tmp_path}/{x}" for x in ("rollup", "anomalies", "state"))
    late = START + timedelta(minutes=30)
    parts = [[r for r in rows if r[0] < late], [r for r in rows if r[0] > late], [r for r in rows if r[0] == late]]
    for batch_id, part in enumerate(parts):
        tables.ROLLUP_TABLE.write(buckets(spark, part), table)
        for _ in range(2):  # a repeated batch changes nothing
            stream_detect.detect_batch(buckets(spark, part), batch_id, table, found, state, s)
    got = tables.ANOMALY_TABLE.read(spark, found)
    want = detect.detect(buckets(spark, rows), s)
    assert as_set(got, "bucket_ts", "anomaly_type") == as_set(want, "bucket_ts", "anomaly_type")
    assert got.count() == want.count() > 0
    assert [(r.late_readings, r.batch) for r in stream_ewma.late_readings(spark, state).collect()] == [(1, 2)]


def test_late_buckets_withdraw_and_change_findings(spark, tmp_path):
    rows, s = noisy(240, seed=5), DetectSettings()
    # a bucket that looks like a spike until its loud neighbours arrive
    rows = [r for r in rows if r[1] != "auth"] + [
        bucket_row(m, 100.0 + m % 5 + (4000.0 if m in (20, 22, 24, 30) else 0.0), 200.0 + m % 7, service="auth") for m in range(60)]
    late = [r for r in rows if r[0].minute % 4 == 0 and r[0] != START]
    parts = [[r for r in rows if r not in late], late[: len(late) // 2], late[len(late) // 2:]]
    table, found, state = (f"{tmp_path}/{x}" for x in ("rollup", "anomalies", "state"))
    seen = []
    for batch_id, part in enumerate(parts):
        tables.ROLLUP_TABLE.write(buckets(spark, part), table)
        for _ in range(2):  # a repeated batch changes nothing
            stream_detect.detect_batch(buckets(spark, part), batch_id, table, found, state, s, START)
            seen.append(tables.VERSION_TABLE.read(spark, tables.versions_path(found)).count())
    assert seen[0] == seen[1] == 0 < seen[2] == seen[3] < seen[4] == seen[5]
    versions = tables.VERSION_TABLE.read(spark, tables.versions_path(found))
    assert {r.withdrawn for r in versions.collect()} == {True, False}
    names = ["bucket_ts", "service", "anomaly_type", "severity"]
    got = tables.current_anomalies(spark, found).filter(F.col("anomaly_type") != detect.ERROR_BURST)
    want = detect.detect(buckets(spark, rows), s).filter(F.col("anomaly_type") != detect.ERROR_BURST)
    shown = lambda df: {(*tuple(r)[:4], round(r.z_score, 9)) for r in df.select(*names, "z_score").collect()}
    assert shown(got) == shown(want) and got.count() == want.count() > 3


def test_lost_state_is_an_error(spark, tmp_path):
    s, rows = DetectSettings(), [bucket_row(m, 1.0, 2.0) for m in range(4)]
    tables.ROLLUP_TABLE.write(buckets(spark, rows), f"{tmp_path}/rollup")
    with pytest.raises(RuntimeError, match="state before batch 3"):
        stream_detect.detect_batch(buckets(spark, rows), 3, f"{tmp_path}/rollup", f"{tmp_path}/a", f"{tmp_path}/s", s)


def test_old_states_go(spark, tmp_path):
    readings = buckets(spark, [bucket_row(m, 1.0, 2.0) for m in range(6)]).selectExpr("service", "bucket", "0.1D rate")
    for batch_id in range(4):
        part = readings.filter(F.minute("bucket") == batch_id)
        stream_ewma.baseline_batch(part, batch_id, f"{tmp_path}/s", f"{tmp_path}/o")
    assert sorted(p.name for p in (tmp_path / "s").glob("before=*")) == ["before=3", "before=4"]


def test_counters_become_a_panel(spark, tmp_path):
    p, counted = Places(tmp_path), f"{tmp_path}/counters"
    assert counters.samples(spark, counted).count() == 0
    for k in range(3):
        df = spark.createDataFrame([(message(10 * k + i),) for i in range(4)] + [("junk",)], "value string")
        for _ in range(2):  # a repeated batch counts once
            ingest.ingest_batch(df, k, p.events, p.quarantine, counted, START + timedelta(days=k // 2, seconds=15 * k))
    samples = counters.samples(spark, counted)
    written = samples.filter("metric = 'ingestion_events_written_total'")
    assert [r.value for r in written.orderBy("ts").collect()] == [4.0, 8.0, 12.0]
    consumed = samples.filter("metric = 'ingestion_events_consumed_total'").orderBy("ts").collect()
    assert [(r.labels, r.value) for r in consumed] == [({"service": "checkout"}, v) for v in (4.0, 8.0, 12.0)]
    panel = next(x for x in panels.PANELS if x.title == "events ingested")
    assert panels.plot(samples, panel).filter("value > 0").count() > 0
    sizes = next(x for x in panels.PANELS if (x.title, x.legend) == ("batch size", "p95"))
    assert panels.plot(samples, sizes).filter("value between 1 and 10").count() > 0


def test_back_pressure_follows_measured_flushes(spark, tmp_path):
    path, s = f"{tmp_path}/c", IngestSettings(flush_target_s=10, paced_by=2)
    assert counters.messages_per_trigger(spark, path, s) == s.max_per_trigger
    batches = [(9_000, 1.0), (2_000, 4.0), (1_000, 2.0)]  # the first is too old to count
    for k, (size, seconds) in enumerate(batches):
        entries = [*counters.observed_once("ingestion_batch_size", size, [10]),
                   *counters.observed_once("ingestion_batch_flush_duration_seconds", seconds, [1])]
        counters.record(spark, path, "ingest", k, entries, when=START + timedelta(minutes=k))
    assert counters.messages_per_trigger(spark, path, s) == 5_000
    assert counters.messages_per_trigger(spark, path, IngestSettings(flush_target_s=10, paced_by=2, max_per_trigger=700)) == 700
    assert counters.messages_per_trigger(spark, path, IngestSettings(flush_target_s=10, paced_by=2, batch_size=8_000)) == 8_000


def test_failed_writes_are_counted(spark, tmp_path, monkeypatch):
    def broken(*_):
        raise RuntimeError("table is gone")

    monkeypatch.setattr(ingest, "insert_events", broken)
    df = spark.createDataFrame([(message(1),)], "value string")
    for _ in range(2):
        with pytest.raises(RuntimeError):
            ingest.ingest_batch(df, 0, f"{tmp_path}/e", f"{tmp_path}/q", f"{tmp_path}/c")
    assert counters.samples(spark, f"{tmp_path}/c").agg(F.sum("value")).first()[0] == 3.0  # one after the other: 1, then 2


def test_watermarked_dedupe_drops_copies(spark, tmp_path):
    rows = [event(i % 50, START + timedelta(seconds=i % 50)) for i in range(150)]
    event_files(spark, f"{tmp_path}/in", [rows])
    unique = ingest.deduplicated(event_stream(spark, f"{tmp_path}/in"), "10 minutes")
    unique.writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
        "checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 50
