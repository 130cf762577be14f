"""Exact interpolated quantiles per group, including groups too big for one task.

The built-in ``percentile`` keeps a value-to-count map per group in one task.
That is right for ordinary groups. For a group that holds a large share of all
rows, ``select_quantile`` finds the two neighbouring order statistics by
narrowing a value range: every pass counts the rows per value bin (combined
before the shuffle), keeps the bin that holds the wanted rank and goes on inside
it. The first pass uses logarithmic bins, 64 per power of two. Inside one such
bin doubles are evenly spaced, so each equal-width pass with 4096 bins removes
12 bits from the 46 that are left: after two, at most about 2**22 distinct values
remain per group whatever the distribution, and they are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096
BINS_PER_OCTAVE = 64
LINEAR_PASSES = 2
# Log2 of the largest and smallest doubles stays within this.
LOG_RANGE = 1100.0


def _log_bin(value: Column) -> Column:
    """Bin number that never decreases with the value."""
    size = F.least(F.greatest(F.log2(F.abs(value)), F.lit(-LOG_RANGE)), F.lit(LOG_RANGE))
    step = (F.floor((size + LOG_RANGE) * BINS_PER_OCTAVE) + 1).cast("long")
    top = F.lit(int(2 * LOG_RANGE * BINS_PER_OCTAVE) + 2).cast("long")
    return (
        F.when(F.isnan(value), top)
        .when(value > 0, step)
        .when(value < 0, -step)
        .otherwise(F.lit(0).cast("long"))
    )


def _linear_bin(value: Column, low: Column, high: Column) -> Column:
    share = (value - low) / (high - low)
    return F.when(high > low, F.floor(share * BINS)).otherwise(F.lit(0)).cast("long")


def _holding_rank(counts: DataFrame, group: list[str], order: str) -> DataFrame:
    """The one row per group whose count range holds the group's rank.

    ``counts`` has at most one row per bin, so a group is bounded here.
    """
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    upto = counts.withColumn("_upto", F.col("_below") + F.sum("_n").over(w))
    return upto.filter(
        (F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_n") <= F.col("_rank"))
    ).withColumn("_below", F.col("_upto") - F.col("_n"))


def select_quantile(
    rows: DataFrame, keys: list[str], value: str, q: float, out: str,
    weight: str | None = None, few_groups: bool = False,
) -> DataFrame:
    """Exact interpolated ``q``-quantile of ``value`` per ``keys``, any group size.

    ``weight`` names a column saying how often a row's value occurs. ``rows`` is
    scanned once per pass, so it should be a table scan. ``few_groups`` says
    that the caller has counted the groups and the rank table, which has at most
    two rows per group, can be broadcast; otherwise the planner decides.
    """
    times = F.lit(1) if weight is None else F.col(weight)
    values = rows.filter(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("_v"), times.cast("long").alias("_w")
    )
    counted = [F.sum("_w").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")]
    first = values.groupBy(*keys, _log_bin(F.col("_v")).alias("_bin")).agg(*counted)
    position = F.lit(q) * (F.sum("_n").over(Window.partitionBy(*keys)) - 1)
    ranked = first.withColumn("_position", position).withColumn(
        "_rank",
        F.explode(F.array_distinct(F.array(F.floor("_position"), F.ceil("_position")))),
    ).withColumn("_below", F.lit(0).cast("long"))
    target = [*keys, "_position", "_rank"]
    state = _holding_rank(ranked, [*keys, "_rank"], "_bin").select(
        *target, "_below", "_low", "_high"
    )
    small = F.broadcast if few_groups else (lambda table: table)
    for _ in range(LINEAR_PASSES):
        inside = _inside(values, small(state), keys)
        binned = inside.groupBy(
            *target, "_below",
            _linear_bin(F.col("_v"), F.col("_low"), F.col("_high")).alias("_bin"),
        ).agg(*counted)
        state = _holding_rank(binned, [*keys, "_rank"], "_bin").select(
            *target, "_below", "_low", "_high"
        )
    remaining = _inside(values, small(state), keys).groupBy(*target, "_below", "_v").agg(
        F.sum("_w").alias("_n")
    )
    found = _holding_rank(remaining, [*keys, "_rank"], "_v")
    # Interpolate between the neighbours exactly as the built-in does.
    lower, upper = F.floor("_position"), F.ceil("_position")
    pairs = found.groupBy(*keys, "_position").agg(
        F.min_by("_v", "_rank").alias("_first"), F.max_by("_v", "_rank").alias("_last")
    )
    mixed = (upper - F.col("_position")) * F.col("_first") + (
        F.col("_position") - lower
    ) * F.col("_last")
    same = (lower == upper) | F.col("_first").eqNullSafe(F.col("_last"))
    return pairs.select(*keys, F.when(same, F.col("_first")).otherwise(mixed).alias(out))


def _inside(values: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in the value range of their group's target, once per target."""
    return values.join(state, keys).filter(
        F.col("_v").between(F.col("_low"), F.col("_high"))
    )
