"""Time arithmetic as columns. Every function takes its clock as a parameter."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Buckets are counted from Monday 2000-01-03 00:00 UTC, so that week-long
# buckets start on a Monday.
ORIGIN_S = 946_857_600
MICROS = 1_000_000

# RFC 3339 date-time: 'T' separator, optional fraction, offset required.
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def instant(value: datetime | str | Column) -> Column:
    """A timestamp column from a literal or a column."""
    column = value if isinstance(value, Column) else F.lit(value)
    return column.cast("timestamp")


def seconds_before(as_of: datetime | str | Column, seconds: float) -> Column:
    micros = F.unix_micros(instant(as_of)) - F.lit(round(seconds * MICROS))
    return F.timestamp_micros(micros)


def bucket_start(ts: Column, width_s: int) -> Column:
    """Start of the fixed-width bucket holding ``ts``."""
    secs = F.unix_seconds(ts)
    return F.timestamp_seconds(secs - F.pmod(secs - F.lit(ORIGIN_S), F.lit(width_s)))


def bucket_index(bucket: Column, width_s: int) -> Column:
    """Number of the bucket that starts at ``bucket``."""
    return steps_down(F.unix_seconds(bucket) - F.lit(ORIGIN_S), width_s)


def first_index_from(start: Column, width_s: int) -> Column:
    """Number of the first bucket starting at or after ``start``."""
    width_us = width_s * MICROS
    offset = F.unix_micros(start) - F.lit(ORIGIN_S * MICROS)
    up = offset + F.pmod(-offset, F.lit(width_us))
    return steps_down(up, width_us)


def steps_down(offset: Column, step: int) -> Column:
    """Whole steps in an integer offset, rounded down, in integer arithmetic."""
    return F.call_function("div", offset - F.pmod(offset, F.lit(step)), F.lit(step))


def parse_rfc3339(text: Column) -> Column:
    """Timestamp of an RFC 3339 text, NULL for anything else."""
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(text))


def iso_format(ts: Column) -> Column:
    """ISO 8601 text in UTC; the fraction appears only when it is not zero."""
    whole = F.pmod(F.unix_micros(ts), F.lit(MICROS)) == 0
    return F.when(
        whole, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    ).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))


def time_ago(as_of: datetime | str | Column, ts: Column) -> Column:
    """Age as ``Ns ago``, ``Nm ago`` or ``Nh ago``, each rounded down."""
    micros = F.unix_micros(instant(as_of)) - F.unix_micros(ts)
    secs = F.floor(micros / MICROS)
    minutes = F.floor(secs / 60)
    hours = F.floor(minutes / 60)
    amount = (
        F.when(secs < 60, F.concat(secs.cast("string"), F.lit("s")))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m")))
        .otherwise(F.concat(hours.cast("string"), F.lit("h")))
    )
    return F.concat(amount, F.lit(" ago"))


def lookback_hours(hours: Column, default: int) -> Column:
    """Requested lookback; none and zero mean the default."""
    return F.coalesce(F.nullif(hours, F.lit(0)), F.lit(default))


def window_start(as_of: Column, hours: Column) -> Column:
    micros = F.unix_micros(as_of) - hours.cast("long") * F.lit(3600 * MICROS)
    return F.timestamp_micros(micros)
