from __future__ import annotations

import math
import random
from datetime import timedelta

import pytest
from helpers import START
from pyspark.sql import functions as F

from tidewatch.operators import metrics
from tidewatch.plans import panels


def samples(spark, pairs, series="a"):
    return spark.createDataFrame(
        [(series, START + timedelta(seconds=t), float(v)) for t, v in pairs],
        "series string, ts timestamp, value double")


def rate_at(df, minute, **kwargs):
    rows = metrics.rate(df, ["series"], 60, 15, **kwargs).withColumn(
        "s", F.unix_seconds("ts") - int(START.timestamp())).collect()
    return {r.s: r.rate for r in rows}[minute * 60]


def test_rate_counts_resets_from_zero(spark):
    # 10 -> 20 -> 5 (restart) -> 8: 10 + 5 + 3.
    df = samples(spark, [(0, 10), (15, 20), (30, 5), (45, 8)])
    assert rate_at(df, 1, extrapolate=False) == pytest.approx(18 / 60)


def test_steady_counter_has_its_rate(spark):
    # One count per 15 s: a full window holds both edges and needs no stretching.
    df = samples(spark, [(15 * i, 100 + i) for i in range(12)])
    assert rate_at(df, 1) == pytest.approx(1 / 15)
    assert rate_at(df, 1, extrapolate=False) == pytest.approx(4 / 60)
    # The sample at the start of the data is the end of a window that holds it alone.
    assert metrics.rate(df, ["series"], 60, 15).agg(F.min("ts")).first()[0] == START.replace(tzinfo=None) + timedelta(
        seconds=15)


def test_extrapolated_rate_by_hand(spark):
    # Samples at 5, 20, 35, 50 s; window 0-60. Gaps 5 s and 10 s are both under
    # 1.1 * 15 s; the counter would have been zero 100 s before the first sample.
    df = samples(spark, [(5, 100), (20, 115), (35, 130), (50, 145)])
    assert rate_at(df, 1, extrapolate=True) == pytest.approx(45 * (45 + 5 + 10) / 45 / 60)


def test_extrapolation_stops_at_zero_and_at_half_an_interval(spark):
    # First sample 2 of an increase of 30 over 30 s: zero 2 s before it.
    # 25 s to the window's end is over 1.1 intervals, so half of one counts.
    df = samples(spark, [(5, 2), (20, 17), (35, 32)])
    assert rate_at(df, 1, extrapolate=True) == pytest.approx(30 * (30 + 2 + 7.5) / 30 / 60)


def test_one_sample_has_no_rate(spark):
    assert metrics.rate(samples(spark, [(5, 1)]), ["series"], 60, 15).isEmpty()


@pytest.mark.parametrize("window_s, step_s", [(60, 15), (300, 15), (60, 60)])
def test_rate_equals_plain_windows(spark, window_s, step_s):
    rng = random.Random(window_s)
    pairs, value = [], 0
    for t in sorted(rng.sample(range(1200), 200)):
        value = rng.randrange(5) if rng.random() < 0.05 else value + rng.randrange(9)
        pairs.append((t, value))
    got = {
        r.s: r.rate for r in metrics.rate(samples(spark, pairs), ["series"], window_s, step_s, extrapolate=False)
        .withColumn("s", F.unix_seconds("ts") - int(START.timestamp())).collect()}
    want = {}
    for end in range(step_s, 1200 + window_s + 1, step_s):
        inside = [v for t, v in pairs if end - window_s <= t <= end]
        if len(inside) >= 2:
            want[end] = sum(b if b < a else b - a for a, b in zip(inside, inside[1:])) / window_s
    assert got == pytest.approx(want)


def buckets(spark, counts):
    return spark.createDataFrame([("x", float(le), float(c)) for le, c in counts],
                                 "g string, le double, cumulative_count double")


@pytest.mark.parametrize(
    "counts, phi, expected",
    [
        ([(1, 0), (10, 50), (100, 100), (math.inf, 100)], 0.5, 10.0),
        ([(1, 0), (10, 50), (100, 100), (math.inf, 100)], 0.75, 55.0),
        ([(1, 10), (math.inf, 10)], 0.5, 0.5),
        ([(1, 1), (10, 2), (math.inf, 100)], 0.95, 10.0),
        ([(1, 0), (math.inf, 0)], 0.5, math.nan),
        ([(1, 5), (10, 5)], 0.5, math.nan),
        ([(math.inf, 5)], 0.5, math.nan),
        ([(-5, 4), (10, 5), (math.inf, 5)], 0.5, -5.0),
        ([(1, 4), (2, 3), (math.inf, 4)], 1.0, 1.0),
        ([(1, 1), (math.inf, 2)], 1.5, math.inf),
        ([(1, 1), (math.inf, 2)], -0.5, -math.inf),
    ],
)
def test_histogram_quantile(spark, counts, phi, expected):
    got = metrics.histogram_quantile(buckets(spark, counts), ["g"], phi).first().quantile
    assert got == pytest.approx(expected, nan_ok=True)


def test_histogram_is_cumulative(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (7.0,), (501.0,)], "v double")
    rows = metrics.histogram(df, [], "v", metrics.BATCH_SIZE_BOUNDS)
    got = {r.label: r.cumulative_count for r in rows.withColumn(
        "label", metrics.le_label(F.col("le"))).collect()}
    assert got == {"1": 2, "10": 3, "25": 3, "50": 3, "100": 3, "200": 3, "500": 3, "+Inf": 4}
    assert {(r.total_sum, r.total_count) for r in rows.collect()} == {(509.5, 4)}


def test_every_panel_draws(spark):
    for panel in panels.PANELS:
        labels = ["1", "5", "+Inf"] if panel.phi else ["x"]
        rows = [
            ("app_" + panel.metric, {"le": le, "severity": "critical", "service": "s"},
             START + timedelta(seconds=15 * i), float(i * (n + 1)))
            for n, le in enumerate(labels) for i in range(60)]
        df = spark.createDataFrame(rows, "metric string, labels map<string,string>, ts timestamp, value double")
        drawn = panels.plot(df, panel, prefix="app_")
        assert "ts" in drawn.columns and "value" in drawn.columns
        steady = drawn.filter(F.col("ts") == F.lit(START + timedelta(minutes=12)).cast("timestamp")).collect()
        assert len(steady) == 1 and steady[0].value > 0, panel
        if panel.by:
            assert steady[0].severity == "critical"
    assert len(panels.PANELS) == 12 and len({p.title for p in panels.PANELS}) == 9


def test_all_panels_in_one_pass(spark, tmp_path):
    rnd = random.Random(3)
    rows = []
    for metric in {p.metric for p in panels.PANELS} | {"other_total"}:
        for service in ("s", "t"):
            for severity in ("low", "high"):
                for le in ("1", "5", "+Inf") if metric.endswith("_bucket") else (None,):
                    labels = {"service": service, "severity": severity, **({"le": le} if le else {})}
                    value = 0.0
                    for k in range(40):
                        value = 0.0 if rnd.random() < 0.05 else value + rnd.randrange(5)
                        rows.append(("app_" + metric, labels, START + timedelta(seconds=15 * k + rnd.randrange(9)), value))
    spark.createDataFrame(rows, "metric string, labels map<string,string>, ts timestamp, value double").write.parquet(
        str(tmp_path / "samples"))
    df = spark.read.parquet(str(tmp_path / "samples"))
    drawn = panels.plot_all(df, prefix="app_")
    assert drawn._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    found = {(r.title, r.legend, r.series, r.ts): r.value for r in drawn.collect()}
    wanted = {}
    for panel in panels.PANELS:
        for r in panels.plot(df, panel, prefix="app_").collect():
            kept = r.series if panel.shape == "rate" else ",".join(f"{name}={r[name]}" for name in panel.by)
            wanted[panel.title, panel.legend, kept, r.ts] = r.value
    assert found.keys() == wanted.keys() and len(found) > 300
    for key, value in wanted.items():
        assert found[key] == pytest.approx(value, nan_ok=True), key
    assert panels.plot_all(df.limit(0)).count() == 0

