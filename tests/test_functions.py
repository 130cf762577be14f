from __future__ import annotations

from datetime import datetime, timedelta
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal

import pytest
from helpers import utc
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.functions import scoring, text, times

NAN = float("nan")


@pytest.mark.parametrize(
    "z, upward, both",
    [
        (1.0, None, None),
        (2.6, "warning", "warning"),
        (4.5, "critical", "critical"),
        (-4.5, None, "critical"),
        (-10.0, None, "critical"),
        (2.5, "warning", "warning"),
        (4.0, "critical", "critical"),
        (NAN, None, None),
    ],
)
def test_severity(values, z, upward, both):
    assert values(scoring.severity_upward(F.col("z"), 2.5, 4.0), z=z) == upward
    assert values(scoring.severity_both_ways(F.col("z"), 2.5, 4.0), z=z) == both


@pytest.mark.parametrize(
    "events, errors, rate, burst",
    [(200, 20, 0.1, 0.1), (0, 0, 0.0, None), (None, None, 0.0, None), (100, None, 0.0, None)],
)
def test_rates(spark, events, errors, rate, burst):
    row = spark.createDataFrame([(events, errors)], "e long, r long").select(
        scoring.error_rate(F.col("e"), F.col("r")).alias("rate"),
        scoring.error_pct(F.col("e"), F.col("r")).alias("pct"),
        scoring.burst_rate(F.col("e"), F.col("r")).alias("burst"),
    ).first()
    assert (row.rate, row.pct, row.burst) == (rate, rate * 100, burst)


def test_ewma_z_scale_has_a_floor(values):
    z = scoring.ewma_z(F.col("x"), F.col("b"))
    assert values(z, x=0.6, b=0.02) == pytest.approx(29.0)
    assert values(z, x=0.05, b=0.0) == pytest.approx(5.0)


@pytest.mark.parametrize(
    "rate, status", [(0.0, "healthy"), (0.1, "warning"), (0.3, "critical"), (0.29, "warning")]
)
def test_health_status(values, rate, status):
    assert values(scoring.health_status(F.col("r")), r=rate) == status


@pytest.mark.parametrize("code, level", [(200, "INFO"), (404, "WARN"), (500, "ERROR"), (401, "WARN")])
def test_level_from_status(values, code, level):
    assert values(scoring.level_from_status(F.col("c")), c=code) == level


@pytest.mark.parametrize(
    "value, expected",
    [(None, 24.0), ("30", 30.0), ("6", 6.0), ("abc", 24.0), ("not-a-number", 24.0), ("0", 24.0),
     ("-10", 24.0), ("-5", 24.0), ("", 24.0), (" 30\t", 30.0), ("1e2", 100.0), ("Infinity", 24.0),
     ("NaN", 24.0), ("1.5f", 24.0), ("12d", 24.0), (".5", 0.5)],
)
def test_positive_parameter(values, value, expected):
    assert values(text.positive_or(F.col("v").cast("string"), 24), v=value) == expected


def test_number_or_zero(values):
    for value, expected in [("200", 200.0), ("x", 0.0), (None, 0.0), ("", 0.0), ("-1.5", -1.5)]:
        assert values(text.number_or_zero(F.col("v").cast("string")), v=value) == expected


@pytest.mark.parametrize(
    "value, digits, even, up",
    [(2.5, 0, "2", "3"), (1.005, 2, "1.00", "1.00"), (0.125, 2, "0.12", "0.13"),
     (-2.5, 0, "-2", "-3"), (1e15, 1, "1000000000000000.0", "1000000000000000.0"),
     (0.0, 2, "0.00", "0.00"), (150.4987, 0, "150", "150"), (99.995, 2, "100.00", "100.00"),
     (10000000000000.125, 2, "10000000000000.12", "10000000000000.13"), (0.999, 2, "1.00", "1.00"),
     (2251799813685249.5, 0, "2251799813685250", "2251799813685250"),
     (2251799813685248.5, 0, "2251799813685248", "2251799813685249"),
     (-1e16, 1, "-10000000000000000.0", "-10000000000000000.0"), (1e23, 0, "99999999999999991611392",
                                                                 "99999999999999991611392"),
     (-2.0**63, 2, "-9223372036854775808.00", "-9223372036854775808.00")],
)
def test_fixed_point(values, value, digits, even, up):
    assert values(text.fixed_point(F.col("x"), digits), x=value) == even
    assert values(text.fixed_point(F.col("x"), digits, "up"), x=value) == up


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.one_of(
            st.floats(-1e6, 1e6, allow_nan=False).filter(lambda x: x == 0 or abs(x) > 1e-9),
            st.integers(-10**8, 10**8).map(lambda n: n / 1000),
            st.integers(-10**5, 10**5).map(lambda n: n / 16),
            st.floats(1e12, 1e20),
        ),
        min_size=20, max_size=60,
    )
)
def test_fixed_point_rounds_the_exact_value(spark, numbers):
    """Same as Python's own formatting, and as decimals rounded half up."""
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    columns = [
        text.fixed_point(F.col("x"), d, ties).alias(f"{ties}{d}")
        for d in (0, 1, 2) for ties in ("even", "up")
    ]
    for row in df.select("x", *columns).collect():
        for d in (0, 1, 2):
            exact, unit = Decimal(abs(row.x)), Decimal(1).scaleb(-d)
            sign = "-" if row.x < 0 else ""
            assert row[f"even{d}"] == sign + str(exact.quantize(unit, ROUND_HALF_EVEN))
            assert row[f"up{d}"] == sign + str(exact.quantize(unit, ROUND_HALF_UP))


def test_canonical_uuid(values):
    wanted = "0a0b0c0d-0000-4000-8000-000000000001"
    for spelled in (wanted, wanted.upper(), wanted.replace("-", "")):
        assert values(text.canonical_uuid(F.col("u")), u=spelled) == wanted
    for wrong in ("", "abc-123", wanted + "0", wanted[:-1] + "g"):
        assert values(text.canonical_uuid(F.col("u")), u=wrong) is None


def test_normalize_question(values):
    clean = text.normalize_question(F.col("q"))
    assert values(clean, q=" \n\t why? \r\n") == "why?"
    assert values(clean, q=" \t\n  ") is None


def test_parse_rfc3339(values):
    parse = times.parse_rfc3339(F.col("t")).cast("string")
    good = {
        "2026-07-20T16:30:11.979003225Z": "2026-07-20 16:30:11.979003",
        "2026-07-20T16:30:11Z": "2026-07-20 16:30:11",
        "2026-07-20T16:30:11.5+05:30": "2026-07-20 11:00:11.5",
    }
    for spelled, expected in good.items():
        assert values(parse, t=spelled) == expected
    for wrong in ("not-a-timestamp", "", "2026-07-20", "2026-07-20 16:30:11Z", "2026-07-20T16:30:11",
                  "2026-13-20T16:30:11Z", "2026-07-20T25:30:11Z", "2026-02-30T00:00:00Z"):
        assert values(parse, t=wrong) is None


def test_time_ago(values):
    now = datetime(2026, 7, 22, 12, 0, 0)
    for back, expected in [(timedelta(seconds=59, microseconds=999999), "59s ago"),
                           (timedelta(seconds=60), "1m ago"), (timedelta(minutes=59, seconds=59), "59m ago"),
                           (timedelta(hours=1), "1h ago"), (timedelta(hours=49, minutes=30), "49h ago")]:
        age = times.time_ago(F.lit(str(now)), F.lit(str(now - back)).cast("timestamp"))
        assert values(age, x=1) == expected


def test_iso_format(values):
    show = times.iso_format(F.col("t").cast("timestamp"))
    assert values(show, t="2026-07-22 06:00:00") == "2026-07-22T06:00:00+00:00"
    assert values(show, t="2026-07-22 06:00:00.25") == "2026-07-22T06:00:00.250000+00:00"


def test_bucket_numbers(spark):
    df = spark.sql(
        "SELECT explode(sequence(timestamp'1969-12-31 20:00:00', timestamp'1970-01-02 00:00:00',"
        " interval 7 minutes 13 seconds)) AS ts"
    )
    for width in (60, 3600, 420, 86400):
        start = times.bucket_start(F.col("ts"), width)
        rows = df.select(
            F.unix_seconds(start).alias("s"), F.unix_seconds("ts").alias("t"),
            times.bucket_index(start, width).alias("i"),
            times.first_index_from(F.col("ts"), width).alias("n"),
        ).collect()
        for r in rows:
            assert r.s <= r.t < r.s + width and r.i * width + times.ORIGIN_S == r.s
            assert r.n == (r.i if r.s == r.t else r.i + 1)


def test_lookback_default(values):
    hours = times.lookback_hours(F.col("h").cast("int"), 6)
    assert [values(hours, h=h) for h in (None, 0, 3)] == [6, 6, 3]
    start = times.window_start(F.lit(utc(2026, 7, 22, 12)).cast("timestamp"), F.lit(6))
    assert values(start.cast("string"), x=1) == "2026-07-22 06:00:00"
