"""Rates, z-scores, severities and health states as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# An error-rate baseline below this does not shrink the score's scale further.
MIN_RATE_SCALE = 0.01
HEALTH_CRITICAL = 0.3
HEALTH_WARNING = 0.1


def error_rate(events: Column, errors: Column) -> Column:
    """Errors per event; missing counts are zero and no events means rate 0."""
    total = F.coalesce(events, F.lit(0))
    return F.when(total > 0, F.coalesce(errors, F.lit(0)) / total).otherwise(F.lit(0.0))


def error_pct(events: Column, errors: Column) -> Column:
    total = F.coalesce(events, F.lit(0))
    return F.when(total != 0, F.coalesce(errors, F.lit(0)) / total * 100).otherwise(
        F.lit(0.0)
    )


def burst_rate(events: Column, errors: Column) -> Column:
    """Errors per event, or NULL (no reading) when there were no events."""
    return F.when(events > 0, errors / events)


def z_score(value: Column, mean: Column, stddev: Column) -> Column:
    return F.when(stddev > 0, (value - mean) / stddev)


def ewma_z(rate: Column, baseline: Column) -> Column:
    """Deviation from the baseline in units of the baseline itself."""
    return (rate - baseline) / F.greatest(baseline, F.lit(MIN_RATE_SCALE))


def severity_upward(z: Column, warning: float, critical: float) -> Column:
    """Severity of a positive deviation. NaN, which Spark orders above every
    number, is no deviation at all."""
    graded = F.when(z >= critical, "critical").when(z >= warning, "warning")
    return F.when(~F.isnan(z), graded)


def severity_both_ways(z: Column, warning: float, critical: float) -> Column:
    return severity_upward(F.abs(z), warning, critical)


def health_status(rate: Column) -> Column:
    return (
        F.when(rate >= HEALTH_CRITICAL, "critical")
        .when(rate >= HEALTH_WARNING, "warning")
        .otherwise("healthy")
    )


def level_from_status(status_code: Column) -> Column:
    return (
        F.when(status_code >= 500, "ERROR")
        .when(status_code >= 400, "WARN")
        .otherwise("INFO")
    )
