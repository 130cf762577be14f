"""Predicates shared by the reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import seconds_before


# The date partition of the stored tables, by the time column that it is the date of.
DATE_OF = {"ts": "event_date", "bucket": "bucket_date", "detected_at": "detected_date"}


def on_or_after(rows: DataFrame, column: str, start: Column) -> DataFrame:
    """Rows at or after ``start``; a stored table with its date partition reads only those dates."""
    kept = rows.filter(F.col(column) >= start)
    if DATE_OF.get(column) in rows.columns:
        kept = kept.filter(F.col(DATE_OF[column]) >= F.to_date(start))
    return kept


def since(rows: DataFrame, column: str, as_of, seconds: float) -> DataFrame:
    """Rows at or after ``as_of`` minus ``seconds``; there is no upper bound.

    Older date partitions of a stored table are not even listed.
    """
    return on_or_after(rows, column, seconds_before(as_of, seconds))


def matching(rows: DataFrame, column: str, wanted: str | None) -> DataFrame:
    """Equality that applies only when a value is asked for."""
    return rows if wanted is None else rows.filter(F.col(column) == wanted)


def error_events(events: DataFrame) -> DataFrame:
    return events.filter(F.col("level") == "ERROR")


def injected_events(events: DataFrame) -> DataFrame:
    return events.filter(F.col("anomaly_injected"))


def critical(anomalies: DataFrame) -> DataFrame:
    return anomalies.filter(F.col("severity") == "critical")


def between(rows: DataFrame, column: str, start: Column, end: Column) -> DataFrame:
    return rows.filter((F.col(column) >= start) & (F.col(column) < end))


def newest_first(rows: DataFrame, column: str, *ties: str) -> DataFrame:
    return rows.orderBy(F.col(column).desc(), *ties)
