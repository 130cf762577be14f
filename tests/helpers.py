"""Small inputs in the shape of the tables."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from tidewatch import schemas

START = datetime(2026, 7, 20, 12, 0, tzinfo=timezone.utc)


def utc(*parts: int) -> datetime:
    return datetime(*parts, tzinfo=timezone.utc)


def bucket_row(minute: int, p95, peak, errors: int = 1, events: int = 100, service="checkout"):
    avg = None if p95 is None else 0.7 * p95
    return (START + timedelta(minutes=minute), service, events, errors, avg, p95, peak)


def buckets(spark, rows):
    return spark.createDataFrame(rows, schemas.ROLLUP)


def uuid(number: int) -> str:
    return f"00000000-0000-4000-8000-{number:012d}"


def event(number: int, ts: datetime, service="checkout", level="INFO", latency=10.0, **other):
    row = {
        "event_id": uuid(number), "ts": ts, "service": service, "endpoint": f"/{service}",
        "level": level, "status_code": 500 if level == "ERROR" else 200,
        "latency_ms": float(latency), "message": "handled", "trace_id": uuid(number + 10**6),
        "anomaly_injected": False, "ingested_at": ts + timedelta(seconds=1),
    }
    return row | other


def events(spark, rows):
    return spark.createDataFrame(
        [tuple(r[n] for n in schemas.LOG_EVENTS.fieldNames()) for r in rows], schemas.LOG_EVENTS
    )


def as_set(df, *names):
    return {tuple(r) for r in df.select(*names).collect()}
