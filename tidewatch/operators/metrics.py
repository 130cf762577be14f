"""Counter rates and histogram quantiles over metric samples.

A series is a ``series`` column list (for example metric and labels). Samples
are first reduced to ordered summaries of short slots, and windows are put
together from slot summaries, so a sliding window multiplies summaries, not
samples. A summary is (first, last, increase, count); two neighbours combine by
adding the increase between the last sample of one and the first of the next.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import MICROS, ORIGIN_S, steps_down

# Histogram upper bounds of the three measured histograms.
BATCH_SIZE_BOUNDS = [1, 10, 25, 50, 100, 200, 500]
QUERY_SECONDS_BOUNDS = [1, 5, 15, 30, 60, 120, 180, 300]
FLUSH_SECONDS_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10]

# Samples of one slot are ordered inside one of this many sub-slots.
SUBSLOTS = 1000


def histogram(rows: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative histogram: (by, le, cumulative_count, total_sum, total_count).

    One aggregation pass; the bounds become rows afterwards.
    """
    edges = [*[float(b) for b in bounds], math.inf]
    v = F.col(value)
    counted = rows.groupBy(*by).agg(
        *[F.count_if(v <= F.lit(edge)).alias(f"_le{i}") for i, edge in enumerate(edges)],
        F.sum(v).alias("total_sum"),
        F.count(v).alias("total_count"),
    )
    entries = F.array(
        *[
            F.struct(F.lit(edge).alias("le"), F.col(f"_le{i}").alias("cumulative_count"))
            for i, edge in enumerate(edges)
        ]
    )
    return counted.select(*by, F.inline(entries), "total_sum", "total_count")


def le_label(le: Column) -> Column:
    """Bound as label text: ``+Inf`` for the last one, no trailing ``.0``."""
    whole = F.when(le == F.floor(le), F.floor(le).cast("string")).otherwise(le.cast("string"))
    return F.when(le == F.lit(math.inf), F.lit("+Inf")).otherwise(whole)


def le_bound(label: Column) -> Column:
    return F.when(label == "+Inf", F.lit(math.inf)).otherwise(label.try_cast("double"))


def histogram_quantile(
    buckets: DataFrame, by: list[str], phi: float | Column, le: str = "le",
    count: str = "cumulative_count", out: str = "quantile",
) -> DataFrame:
    """Quantile estimated from cumulative buckets, one row per ``by``.

    Linear inside the bucket holding the rank, from 0 below the first bound;
    the last finite bound when the rank is above it. NaN without observations,
    without a +Inf bucket or with a single bucket. A group has one row per bound.
    ``phi`` may be a column made of ``by``; without a value for it there is no quantile.
    """
    phi = phi if isinstance(phi, Column) else F.lit(float(phi))
    w = Window.partitionBy(*by).orderBy("_le")
    grown = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    inf = F.lit(math.inf)
    steps = (
        buckets.select(*by, F.col(le).alias("_le"), F.col(count).cast("double").alias("_c"))
        .withColumn("_c", F.max("_c").over(grown))
        .withColumns(
            {
                "_pc": F.lag("_c", 1, 0.0).over(w),
                "_pl": F.lag("_le", 1).over(w),
                "_total": F.max("_c").over(whole),
                "_top": F.max("_le").over(whole),
                "_bounds": F.count("*").over(whole),
            }
        )
    )
    low = F.coalesce(F.col("_pl"), F.lit(0.0))
    rank = F.least(F.greatest(phi, F.lit(0.0)), F.lit(1.0)) * F.col("_total")
    inside = low + (F.col("_le") - low) * (rank - F.col("_pc")) / (F.col("_c") - F.col("_pc"))
    at = (
        F.when(F.col("_le") == inf, F.col("_pl"))
        .when(F.col("_pl").isNull() & (F.col("_le") <= 0), F.col("_le"))
        .when(F.col("_c") > F.col("_pc"), inside)
        .otherwise(low)
    )
    nan = F.lit(math.nan)
    defined = (F.col("_top") == inf) & (F.col("_bounds") >= 2) & (F.col("_total") > 0)
    estimate = F.when(phi < 0, F.lit(-math.inf)).when(phi > 1, F.lit(math.inf)).otherwise(at)
    return (
        steps.filter(F.col("_c") >= F.when(defined, rank).otherwise(F.col("_c")))
        .groupBy(*by)
        .agg(F.min_by(F.when(defined, estimate).otherwise(nan), "_le").alias(out))
    )


def _growth(value: Column, previous: Column) -> Column:
    """Increase of a counter; a smaller value means it restarted from zero."""
    return F.when(value < previous, value).otherwise(value - previous)


def _slot_end(slot: Column, step_s: int) -> Column:
    return F.timestamp_seconds(slot * step_s + F.lit(ORIGIN_S))


def _summaries(samples: DataFrame, series: list[str], step_s: int) -> DataFrame:
    """One summary per (series, slot of ``step_s``), built over sub-slots."""
    step_us = step_s * MICROS
    sub_us = max(step_us // SUBSLOTS, 1)
    offset = F.unix_micros("ts") - F.lit(ORIGIN_S * MICROS)
    placed = samples.select(
        *series,
        F.unix_micros("ts").alias("_t"),
        F.col("value").alias("_v"),
        steps_down(offset, step_us).alias("_slot"),
        steps_down(F.pmod(offset, F.lit(step_us)), sub_us).alias("_sub"),
    )
    w = Window.partitionBy(*series, "_slot", "_sub").orderBy("_t")
    previous = F.lag("_v").over(w)
    parts = (
        placed.withColumn("_grow", F.coalesce(_growth(F.col("_v"), previous), F.lit(0.0)))
        .groupBy(*series, "_slot", "_sub")
        .agg(*_ends("_t", "_v", "_t", "_v"), F.sum("_grow").alias("_inc"),
             F.count("*").alias("_n"))
    )
    return _combined(parts, [*series, "_slot"], "_sub")


def _ends(t0: str, v0: str, t1: str, v1: str) -> list[Column]:
    return [
        F.min(t0).alias("_t0"), F.min_by(v0, t0).alias("_v0"),
        F.max(t1).alias("_t1"), F.max_by(v1, t1).alias("_v1"),
    ]


def _combined(parts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Ordered summaries of a group as one; a group is short by construction."""
    w = Window.partitionBy(*keys).orderBy(order)
    bridge = F.coalesce(_growth(F.col("_v0"), F.lag("_v1").over(w)), F.lit(0.0))
    return (
        parts.withColumn("_bridge", bridge)
        .groupBy(*keys)
        .agg(*_ends("_t0", "_v0", "_t1", "_v1"),
             F.sum(F.col("_inc") + F.col("_bridge")).alias("_inc"), F.sum("_n").alias("_n"))
    )


def rate(
    samples: DataFrame, series: list[str], window_s: int, step_s: int,
    extrapolate: bool = True, out: str = "rate",
) -> DataFrame:
    """Per-second increase of a counter over sliding windows.

    Windows end at every multiple of ``step_s`` and cover the ``window_s``
    before it, which must be a multiple of the step. Both edges belong to a
    window, so a sample on an edge counts in the window that ends there and in
    the one that starts there. Counter restarts are counted from zero; a window
    with one sample has no rate. The increase is stretched towards the window's
    edges the way a metrics server does; without ``extrapolate`` what was seen is
    divided by the window length.
    """
    if window_s % step_s:
        raise ValueError("window_s must be a multiple of step_s")
    summaries = _summaries(samples, series, step_s)
    return _over_windows(summaries, series, F.lit(window_s), step_s, extrapolate, out)


def rates(
    samples: DataFrame, series: list[str], windows: Column, step_s: int, out: str = "rate",
) -> DataFrame:
    """``rate`` over several window lengths at once, with the length as column ``window_s``.

    ``windows`` is an array of lengths in seconds, made of the series columns, each a
    multiple of the step. Samples are read and reduced to slot summaries once for all lengths.
    """
    summaries = _summaries(samples, series, step_s).withColumn("window_s", F.explode(windows))
    return _over_windows(summaries, [*series, "window_s"], F.col("window_s"), step_s, True, out)


def _over_windows(
    summaries: DataFrame, series: list[str], window_s: Column, step_s: int, extrapolate: bool, out: str
) -> DataFrame:
    """Rates from slot summaries; ``window_s`` is made of the series columns."""
    window_s = window_s.cast("long")
    slots = F.floor(window_s / step_s).cast("long")
    on_edge = F.col("_t0") == (F.col("_slot") * step_s + F.lit(ORIGIN_S)) * MICROS
    summaries = summaries.withColumn(
        "_end", F.explode(F.sequence(F.col("_slot") + 1 - on_edge.cast("int"), F.col("_slot") + slots))
    )
    # of the slot that starts where a window ends, that window has the first sample alone
    alone = F.col("_end") == F.col("_slot")
    summaries = summaries.withColumns({
        "_t1": F.when(alone, F.col("_t0")).otherwise(F.col("_t1")),
        "_v1": F.when(alone, F.col("_v0")).otherwise(F.col("_v1")),
        "_inc": F.when(alone, 0.0).otherwise(F.col("_inc")),
        "_n": F.when(alone, 1).otherwise(F.col("_n")),
    })
    windows = _combined(summaries, [*series, "_end"], "_slot").filter(F.col("_n") >= 2)
    increase = F.col("_inc")
    if extrapolate:
        increase = increase * _stretch(window_s, _slot_end(F.col("_end"), step_s))
    return windows.select(
        *series, _slot_end(F.col("_end"), step_s).alias("ts"),
        (increase / window_s.cast("double")).alias(out),
    )


def _stretch(window_s: Column, end: Column) -> Column:
    """Factor that extends the sampled interval to the window's edges: fully
    when the gap is under 1.1 sample intervals, else by half an interval, and
    never to before the counter would have been zero."""
    sampled = (F.col("_t1") - F.col("_t0")) / MICROS
    end_us = F.unix_micros(end)
    to_start = (F.col("_t0") - (end_us - window_s * MICROS)) / MICROS
    to_end = (end_us - F.col("_t1")) / MICROS
    interval = sampled / (F.col("_n") - 1)
    start_gap = F.when(to_start < interval * 1.1, to_start).otherwise(interval / 2)
    end_gap = F.when(to_end < interval * 1.1, to_end).otherwise(interval / 2)
    to_zero = F.when(
        (F.col("_inc") > 0) & (F.col("_v0") >= 0), sampled * F.col("_v0") / F.col("_inc")
    )
    start_gap = F.least(start_gap, F.coalesce(to_zero, start_gap))
    return F.when(sampled > 0, (sampled + start_gap + end_gap) / sampled).otherwise(0.0)


def sum_rates(rates: DataFrame, by: list[str], column: str = "rate") -> DataFrame:
    """Rates added up over all series of each ``by`` group, per moment."""
    return rates.groupBy("ts", *by).agg(F.sum(column).alias(column))


def rate_quantile(
    samples: DataFrame, series: list[str], phi: float, window_s: int, step_s: int,
    by: list[str] | None = None, out: str = "quantile",
) -> DataFrame:
    """Quantile over time of a histogram counter with a label column ``le``."""
    by = by or []
    summed = sum_rates(rate(samples, series, window_s, step_s), [*by, "le"])
    bounds = summed.withColumn("le", le_bound(F.col("le")))
    return histogram_quantile(bounds, ["ts", *by], phi, count="rate", out=out)
