"""Exponentially weighted error-rate baseline over whole series.

The baseline is a recursion, b' = alpha * x + (1 - alpha) * b, which no window
function expresses. One step is an affine map, so a chunk of readings is one
too: b_out = A * b_in + B. Each (service, chunk) is folded to its (A, B), the
few chunks of a service are composed in order to give every chunk its incoming
baseline, and the chunks are then folded again in parallel from there. Within a chunk the same is done with
slices, so that a fold goes over a short array. Arrays hold at most one chunk of
buckets, or one entry per chunk of a service.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import ewma_z


# Points folded one after the other at most.
SLICE = 64


def _weights(alpha: float) -> tuple[Column, Column]:
    return F.lit(float(alpha)), F.lit(1.0 - float(alpha))


def _next(baseline: Column, p: Column, alpha: float) -> Column:
    """Baseline after a point; points without a reading leave it as it is."""
    new, old = _weights(alpha)
    return F.when(p["reading"], new * p["rate"] + old * baseline).otherwise(baseline)


def _fold(points: Column, start: Column, alpha: float) -> Column:
    """Baselines before each point of an ordered array, from ``start``."""
    folded = F.aggregate(
        points,
        F.struct(start.alias("b"), F.array().cast("array<double>").alias("seen")),
        lambda acc, p: F.struct(
            _next(acc["b"], p, alpha).alias("b"),
            F.concat(acc["seen"], F.array(F.when(p["reading"], acc["b"]))).alias("seen"),
        ),
    )
    return folded["seen"]


def _affine(points: Column, alpha: float) -> Column:
    """(A, B) of a chunk."""
    _, old = _weights(alpha)
    return F.aggregate(
        points,
        F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")),
        lambda acc, p: F.struct(
            F.when(p["reading"], old * acc["a"]).otherwise(acc["a"]).alias("a"),
            _next(acc["b"], p, alpha).alias("b"),
        ),
    )


def _slices(points: Column) -> Column:
    """An ordered array in pieces of SLICE points."""
    last = F.call_function("div", F.size(points) - 1, F.lit(SLICE)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last), lambda k: F.slice(points, k * SLICE + 1, F.lit(SLICE))
    )


def _composed(maps: Column) -> Column:
    """One affine map for an array of them, applied in order."""
    return F.aggregate(
        maps,
        F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")),
        lambda acc, m: F.struct((m["a"] * acc["a"]).alias("a"), (m["a"] * acc["b"] + m["b"]).alias("b")),
    )


def _slice_starts(maps: Column, start: Column) -> Column:
    """Baseline before each slice of a chunk."""
    walked = F.aggregate(
        maps,
        F.struct(start.alias("b"), F.array().cast("array<double>").alias("seen")),
        lambda acc, m: F.struct(
            (m["a"] * acc["b"] + m["b"]).alias("b"), F.concat(acc["seen"], F.array(acc["b"])).alias("seen")
        ),
    )
    return walked["seen"]


def _incoming(chunks: DataFrame, state: DataFrame | None) -> DataFrame:
    """Baseline at the start of every (service, chunk).

    A service without a saved state starts from its own first reading; it has
    no baseline in the chunks before that.
    """
    ordered = chunks.groupBy("service").agg(
        F.sort_array(F.collect_list(F.struct("chunk", "a", "b", "first"))).alias("maps")
    )
    start = F.lit(None).cast("double")
    if state is not None:
        saved = state.select("service", F.col("ewma").alias("_saved"))
        ordered = ordered.join(saved, "service", "left")
        start = F.col("_saved")
    starts = F.array().cast("array<struct<chunk:bigint,b_in:double>>")

    def step(acc: Column, m: Column) -> Column:
        b_in = F.coalesce(acc["b"], m["first"])
        entry = F.struct(m["chunk"].alias("chunk"), b_in.alias("b_in"))
        return F.struct(
            (m["a"] * b_in + m["b"]).alias("b"),
            F.concat(acc["starts"], F.array(entry)).alias("starts"),
        )

    carry = F.aggregate(F.col("maps"), F.struct(start.alias("b"), starts.alias("starts")), step)
    return ordered.select("service", F.inline(carry["starts"]))


def with_error_baseline(
    baselined: DataFrame, alpha: float, state: DataFrame | None = None
) -> DataFrame:
    """Adds ``ewma`` (baseline before the bucket's own reading) and ``ewma_z``.

    Input is a frame of ``trailing_baseline``. A bucket takes part when it is
    eligible and has a reading; others pass through with NULLs. ``state`` holds
    (service, ewma) to go on from.
    """
    columns = baselined.columns
    folded = chunked(baselined, alpha)
    starts = _incoming(folded.select("service", "chunk", "a", "b", "first"), state)
    return folded_from(folded.join(starts, ["service", "chunk"]), alpha).select(*columns, "ewma").withColumn(
        "ewma_z", ewma_z(F.col("rate"), F.col("ewma"))
    )


def chunked(baselined: DataFrame, alpha: float) -> DataFrame:
    """Each (service, chunk) with its points in slices, their maps, its own map (a, b) and its first reading."""
    carried = [c for c in baselined.columns if c not in ("bucket", "service", "chunk")]
    reading = (F.col("eligible") & F.col("rate").isNotNull()).alias("reading")
    points = F.sort_array(F.collect_list(F.struct("bucket", reading, *carried)))
    folded = (
        baselined.groupBy("service", "chunk").agg(points.alias("points"))
        .withColumn("slices", _slices(F.col("points")))
        .withColumn("maps", F.transform("slices", lambda points: _affine(points, alpha)))
        .withColumn("map", _composed(F.col("maps")))
    )
    first = F.filter("points", lambda p: p["reading"])
    return folded.select(
        "service", "chunk", "slices", "maps", "map.a", "map.b", F.get(first["rate"], F.lit(0)).alias("first")
    )


def folded_from(chunks: DataFrame, alpha: float) -> DataFrame:
    """The points of ``chunked`` rows with ``ewma``, from the baseline ``b_in`` before each."""
    begun = _slice_starts(F.col("maps"), F.col("b_in"))
    return (
        chunks.select("service", "chunk", F.inline(F.arrays_zip(F.col("slices").alias("points"), begun.alias("b_in"))))
        .withColumn("seen", _fold(F.col("points"), F.col("b_in"), alpha))
        .select(
            "service", "chunk",
            F.inline(F.arrays_zip(F.col("points").alias("p"), F.col("seen").alias("ewma"))),
        )
        .select("service", "chunk", "p.*", "ewma")
    )


def incoming(maps: DataFrame) -> DataFrame:
    """Baseline at the start of every (service, chunk) of a table of chunk maps (a, b, first)."""
    return _incoming(maps.select("service", "chunk", "a", "b", "first"), None)


def final_state(scored: DataFrame, alpha: float) -> DataFrame:
    """Baseline per service after its last reading, to start a later run from."""
    new, old = _weights(alpha)
    return (
        scored.filter(F.col("ewma").isNotNull())
        .groupBy("service")
        .agg(
            F.max("bucket").alias("last_bucket"),
            F.max_by(new * F.col("rate") + old * F.col("ewma"), "bucket").alias("ewma"),
        )
    )
