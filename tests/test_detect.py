from __future__ import annotations

import random
from datetime import timedelta

import pytest
from helpers import START, as_set, bucket_row, buckets
from pyspark.sql import functions as F

from tidewatch.config import DetectSettings
from tidewatch.operators import baseline, detect, ewma

SETTINGS = DetectSettings()
STABLE = [(100, 150), (105, 155), (98, 148), (102, 152), (101, 151)]
SPIKE = [(100, 150), (102, 152), (98, 148), (101, 151), (99, 149), (5000, 6000)]
FASTER = [(500, 600), (510, 610), (490, 590), (505, 605), (495, 595), (10, 15)]


def made(spark, pairs, errors=1):
    return buckets(spark, [bucket_row(i, float(p), float(m), errors) for i, (p, m) in enumerate(pairs)])


def last_only(pairs):
    """The moment at which the last bucket is closed."""
    return START + timedelta(minutes=len(pairs))


def kinds(df):
    return {r.anomaly_type for r in df.collect()}


def test_stable_series_is_quiet(spark):
    assert detect.detect(made(spark, STABLE)).isEmpty()
    assert detect.snapshot(made(spark, STABLE), last_only(STABLE)).isEmpty()


@pytest.mark.parametrize("mode", ["replay", "snapshot"])
def test_spike(spark, mode):
    df = made(spark, SPIKE)
    found = detect.detect(df) if mode == "replay" else detect.snapshot(df, last_only(SPIKE))
    rows = {r.anomaly_type: r for r in found.collect()}
    assert rows.keys() == {"latency_spike", "max_latency_outlier"}
    spike = rows["latency_spike"]
    assert spike.z_score > 0 and spike.severity == "critical"
    assert (spike.metric_value, spike.baseline_mean) == (5000.0, 100.0)


def test_getting_faster_is_no_latency_anomaly(spark):
    assert detect.detect(made(spark, FASTER)).isEmpty()


def test_error_burst(spark):
    rows = [bucket_row(i, 100.0, 150.0, 2) for i in range(5)] + [bucket_row(5, 100.0, 150.0, 60)]
    df = buckets(spark, rows)
    row = detect.detect(df).first()
    assert (row.anomaly_type, row.baseline_stddev, row.severity) == ("error_burst", 0.0, "critical")
    assert row.baseline_mean == pytest.approx(0.02) and row.metric_value == 0.6
    assert row.z_score == pytest.approx(29.0)


def test_error_burst_from_saved_state(spark):
    df = buckets(spark, [bucket_row(i, 100.0, 150.0, 2) for i in range(5)]
                 + [bucket_row(5, 100.0, 150.0, 60)])
    state = spark.createDataFrame([("checkout", 0.02)], "service string, ewma double")
    at = START + timedelta(minutes=6)
    assert kinds(detect.snapshot(df, at, state=state)) == {"error_burst"}
    # A service without any state starts from its own reading.
    nobody = spark.createDataFrame([], "service string, ewma double")
    assert detect.snapshot(df, at, state=nobody).isEmpty()


def test_too_little_history(spark):
    df = made(spark, [(100, 150), (9000, 9999)], errors=90)
    assert detect.detect(df).isEmpty()
    assert detect.snapshot(df, START + timedelta(minutes=2)).isEmpty()


def test_equal_history_has_no_deviation(spark):
    assert detect.detect(made(spark, [(0.1, 0.1)] * 3 + [(9.0, 9.0)])).isEmpty()


def test_drops_cannot_fire(spark):
    rows = [bucket_row(i, 1.0, 1.0, 90) for i in range(6)] + [bucket_row(6, 1.0, 1.0, 0)]
    scored = detect.score(buckets(spark, rows))
    assert scored.agg(F.min("ewma_z")).first()[0] >= -1.0 - 1e-12
    assert detect.detect(buckets(spark, rows)).isEmpty()


def noisy(n=400, services=("checkout", "auth"), seed=11):
    rng = random.Random(seed)
    rows = []
    for s in services:
        for i in range(n):
            if rng.random() < 0.1:
                continue
            events = 0 if rng.random() < 0.05 else rng.randrange(1, 200)
            p95 = None if events == 0 else rng.lognormvariate(4, 0.5)
            peak = None if events == 0 else p95 * rng.uniform(1, 4)
            errors = min(events, rng.randrange(0, 5) * (10 if rng.random() < 0.05 else 1))
            rows.append(bucket_row(i, p95, peak, errors, events, s))
    return rows


def by_hand(rows, s):
    """Every bucket judged against the window before it, one after the other."""
    import statistics

    found, state = set(), {}
    for service in {r[1] for r in rows}:
        series = sorted(r for r in rows if r[1] == service)
        for row in series:
            past = [r for r in series if timedelta(0) < row[0] - r[0] <= timedelta(seconds=s.window_s)]
            if len(past) < 2:
                continue
            for kind, i in (("latency_spike", 5), ("max_latency_outlier", 6)):
                history = [r[i] for r in past if r[i] is not None]
                if row[i] is None or len(history) < 2:
                    continue
                sd = statistics.stdev(history)
                if sd > 0 and (row[i] - statistics.fmean(history)) / sd >= s.z_warning:
                    found.add((row[0], service, kind))
            if row[2] > 0:
                rate = row[3] / row[2]
                before = state.get(service, rate)
                state[service] = s.ewma_alpha * rate + (1 - s.ewma_alpha) * before
                if abs((rate - before) / max(before, 0.01)) >= s.z_warning:
                    found.add((row[0], service, "error_burst"))
    return found, state


@pytest.mark.parametrize("chunk_buckets", [60, 61, 97, 1440])
def test_replay_equals_plain_loop_for_any_chunk(spark, chunk_buckets):
    rows, s = noisy(), DetectSettings(chunk_buckets=chunk_buckets)
    want, state = by_hand(rows, s)
    got = detect.detect(buckets(spark, rows).repartition(5), s)
    seen = {(START + timedelta(seconds=r[0]), r[1], r[2]) for r in as_set(
        got.withColumn("t", F.unix_seconds("bucket_ts") - int(START.timestamp())),
        "t", "service", "anomaly_type")}
    assert seen == want and len(want) > 20
    after = ewma.final_state(detect.score(buckets(spark, rows), s), s.ewma_alpha).collect()
    assert {r.service: r.ewma for r in after} == pytest.approx(state, rel=1e-9)


def test_state_carries_over_a_cut(spark):
    rows, s = noisy(), DetectSettings()
    whole = detect.score(buckets(spark, rows), s).filter("ewma is not null")
    cut = START + timedelta(minutes=200)
    base = baseline.trailing_baseline(buckets(spark, rows), s)
    head = ewma.with_error_baseline(base.filter(F.col("bucket") < F.lit(cut)), s.ewma_alpha)
    state = ewma.final_state(head, s.ewma_alpha)
    tail = ewma.with_error_baseline(base.filter(F.col("bucket") >= F.lit(cut)), s.ewma_alpha, state)
    joined = whole.select("service", "bucket", F.col("ewma").alias("w")).join(
        tail.filter("ewma is not null"), ["service", "bucket"])
    assert joined.count() > 200
    assert joined.agg(F.max(F.abs(F.col("w") - F.col("ewma")))).first()[0] < 1e-12


def test_record_ids_repeat_unless_random(spark):
    found = detect.detect(made(spark, SPIKE))
    at = "2026-07-20 13:00:00"
    first, again = [as_set(detect.as_records(found, at), "id") for _ in range(2)]
    assert first == again and len(first) == 2
    assert as_set(detect.as_records(found, at, random_ids=True), "id").isdisjoint(first)
