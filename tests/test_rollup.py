from __future__ import annotations

import math
import random
from datetime import timedelta

import numpy as np
import pytest
from helpers import START, as_set, event, events
from pyspark.sql import functions as F

from tidewatch.operators import keys, quantile, rollup


def sample_events(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ts = START + timedelta(seconds=rng.randrange(300), microseconds=rng.randrange(10**6))
        # One service has most of the rows, many of them equal.
        service = "checkout" if rng.random() < 0.7 else rng.choice(["auth", "payments"])
        latency = 50.0 if rng.random() < 0.3 else rng.lognormvariate(4, 2)
        rows.append(event(i, ts, service, rng.choice(["INFO", "WARN", "ERROR"]), latency))
    return rows


def by_hand(rows, width):
    groups = {}
    for r in rows:
        sec = int(r["ts"].timestamp())
        groups.setdefault((sec - sec % width, r["service"]), []).append(r)
    return {
        k: (len(g), sum(r["level"] == "ERROR" for r in g),
            float(np.mean([r["latency_ms"] for r in g])),
            float(np.percentile([r["latency_ms"] for r in g], 95)),
            max(r["latency_ms"] for r in g))
        for k, g in groups.items()
    }


def collected(df):
    return {
        (int(r.b), r.service): tuple(r)[2:]
        for r in df.select(
            F.unix_seconds("bucket").alias("b"), "service", "event_count", "error_count",
            "avg_latency_ms", "p95_latency_ms", "max_latency_ms",
        ).collect()
    }


@pytest.mark.parametrize("hot_rows", [None, 500_000, 25, 1, 0])
def test_rollup_matches_hand_computation(spark, hot_rows):
    rows = sample_events(spark)
    got = collected(rollup.rollup(events(spark, rows), 60, hot_rows))
    want = by_hand(rows, 60)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12)


def test_hot_groups_beyond_the_listing_limit(spark, monkeypatch):
    monkeypatch.setattr(rollup, "MAX_LISTED_GROUPS", 2)
    rows = sample_events(spark)
    got = collected(rollup.rollup(events(spark, rows), 60, 10))
    for k, v in by_hand(rows, 60).items():
        assert got[k] == pytest.approx(v, rel=1e-12)


def test_rollup_does_not_depend_on_order_or_partitions(spark):
    rows = sample_events(spark)
    base = collected(rollup.rollup(events(spark, rows)))
    random.Random(1).shuffle(rows)
    again = collected(rollup.rollup(events(spark, rows).repartition(7)))
    assert base.keys() == again.keys()
    for k in base:
        assert base[k] == pytest.approx(again[k], rel=1e-12)


def test_rollup_of_counts_equals_rollup_of_events(spark):
    rows = sample_events(spark)
    df = events(spark, rows)
    counts = df.groupBy(
        rollup.bucket_start(F.col("ts"), 60).alias("bucket"), "service", "latency_ms"
    ).agg(F.count("*").alias("n"), rollup.error_count().alias("errors"))
    for hot_rows in (None, 5):
        got = collected(rollup.rollup_counts(counts, hot_rows))
        for k, v in by_hand(rows, 60).items():
            assert got[k] == pytest.approx(v, rel=1e-9)


AWKWARD = {
    "one": [7.5],
    "two": [1.0, 2.0],
    "equal": [3.25] * 50,
    "signs": [-1e300, -5.0, -0.0, 0.0, 5e-324, 1e-300, 2.0, 1e300, math.inf],
    "gap": [1 + i * 2**-52 for i in range(95)] + [1e6 + i for i in range(5)],
    "close": [1.5 + i * 2**-52 for i in range(300)],
    "nan": [1.0, 2.0, math.nan],
    "integers": [float(i) for i in range(1001)],
}


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_selection_equals_the_builtin(spark, q):
    rows = [(g, v) for g, vs in AWKWARD.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r.x for r in quantile.select_quantile(df, ["g"], "v", q, "x").collect()}
    want = {r.g: r.x for r in df.groupBy("g").agg(F.percentile("v", q).alias("x")).collect()}
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == want[g] or (math.isnan(got[g]) and math.isnan(want[g])), g


def test_selection_counts_weights(spark):
    rng = random.Random(5)
    rows = [("a", float(rng.randrange(50)), rng.randrange(1, 9)) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, v double, n int")
    plain = [v for _, v, n in rows for _ in range(n)]
    got = quantile.select_quantile(df, ["g"], "v", 0.95, "x", "n").first().x
    assert got == pytest.approx(float(np.percentile(plain, 95)))


def test_refresh_recomputes_only_closed_buckets_in_range(spark):
    rows = [event(i, START + timedelta(minutes=i), latency=i) for i in range(20)]
    stale = rollup.rollup(events(spark, rows), hot_rows=None).withColumn(
        "event_count", F.lit(99).cast("long")
    )
    as_of = START + timedelta(minutes=15, seconds=30)
    fresh = rollup.refresh(stale, events(spark, rows), as_of, hot_rows=None)
    counts = {r.m: r.n for r in fresh.select(
        ((F.unix_seconds("bucket") - int(START.timestamp())) / 60).cast("int").alias("m"),
        F.col("event_count").alias("n")).collect()}
    # [12:05:30, 12:14:30] holds the whole buckets 6 to 13.
    assert {m for m, n in counts.items() if n == 1} == set(range(6, 14))
    assert len(counts) == 20


def test_refresh_drops_buckets_without_events(spark):
    rows = [event(1, START + timedelta(minutes=8))]
    gone = rollup.rollup(events(spark, [event(2, START + timedelta(minutes=9))]), hot_rows=None)
    fresh = rollup.refresh(gone, events(spark, rows), START + timedelta(minutes=12), hot_rows=None)
    assert [r.m for r in fresh.select(F.minute("bucket").alias("m")).collect()] == [8]


def test_late_arrivals(spark):
    late = {"ingested_at": START + timedelta(minutes=11)}
    rows = [event(1, START), event(2, START, **late), event(3, START + timedelta(minutes=1), **late)]
    got = rollup.late_arrivals(events(spark, rows), 600).collect()
    assert [(r.late_events, r.max_delay_s) for r in got] == [(1, 660.0)]


def test_service_stats_average_is_unweighted_and_nulls_are_zero(spark):
    df = spark.createDataFrame(
        [("a", 200, 20, 150.0, 300.0), ("a", 2, 0, 50.0, 90.0), ("idle", 0, 0, None, None),
         ("new", None, None, None, None)],
        "service string, event_count long, error_count long, p95_latency_ms double, max_latency_ms double",
    )
    assert as_set(rollup.service_stats(df), "service", "total_events", "total_errors",
                  "avg_p95_latency_ms", "max_latency_ms") == {
        ("a", 202, 20, 100.0, 300.0), ("idle", 0, 0, None, None), ("new", 0, 0, None, None)}


def test_mean_stddev(spark):
    rows = [("m", float(v)) for v in (10, 12, 11, 13, 9)] + [("one", 42.0), ("none", None)]
    got = {r.g: (r.mean, r.stddev) for r in rollup.mean_stddev(
        spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert got["m"] == (pytest.approx(11.0), pytest.approx(np.std([10, 12, 11, 13, 9], ddof=1)))
    assert got["one"] == (42.0, 0.0) and got["none"] == (0.0, 0.0)


def test_first_arrival_wins_and_new_timestamp_is_a_new_event(spark):
    first, second = event(1, START, message="first"), event(
        1, START, message="second", ingested_at=START + timedelta(hours=1))
    moved = event(1, START + timedelta(seconds=1), message="moved")
    df = events(spark, [second, moved, first])
    kept = keys.first_arrivals(df, ["ingested_at"])
    assert as_set(kept, "message") == {("first",), ("moved",)}
    row = keys.written_counts(df).first()
    assert (row.accepted, row.inserted) == (3, 2)


def test_copies_are_limited_before_the_shuffle(spark):
    df = events(spark, [event(1, START)])
    plan = keys.first_arrivals(df, ["ingested_at"])._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan
