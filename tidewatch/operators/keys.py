"""Idempotent-insert building blocks: first arrival wins, known keys stay out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import LOG_EVENT_KEY


def first_arrivals(
    events: DataFrame, order: list[str], keys: list[str] | None = None
) -> DataFrame:
    """One row per key, the earliest by ``order``.

    Spark limits each key to one row before the shuffle (window group limit),
    so a key with very many copies sends one row per task, not all of them.
    """
    keys = keys or LOG_EVENT_KEY
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = events.withColumn("_arrival", F.row_number().over(w))
    return ranked.filter(F.col("_arrival") == 1).drop("_arrival")


def without_known_keys(
    events: DataFrame, existing: DataFrame, keys: list[str] | None = None
) -> DataFrame:
    """Rows whose key is not in ``existing`` yet."""
    keys = keys or LOG_EVENT_KEY
    return events.join(existing.select(*keys), keys, "left_anti")


def consumed_counts(decoded: DataFrame) -> DataFrame:
    """Decoded messages per service, before any timestamp check."""
    rows = decoded
    if "decode_error" in decoded.columns:
        rows = decoded.filter(F.col("decode_error").isNull())
    return rows.groupBy("service").agg(F.count("*").alias("events_consumed"))


def written_counts(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``accepted`` counts rows with a usable timestamp, copies included;
    ``inserted`` counts the rows that a keyed insert would keep.

    Copies are counted per key first, so the total is a sum over keys.
    """
    keys = keys or LOG_EVENT_KEY
    copies = events.filter(F.col("ts").isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("copies")
    )
    return copies.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("accepted"),
        F.count("*").alias("inserted"),
    )
