"""Sample tables read as log data: every row of ``events`` becomes a log event
and every user turn of ``conversations`` a question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DAY, HOUR, DetectSettings
from ..functions.scoring import level_from_status

AS_OF = "2024-01-31 00:00:00"
WIDTH_S = HOUR
SETTINGS = DetectSettings(window_s=60 * HOUR, width_s=HOUR, chunk_buckets=168)
# Redelivered copies arrive this much later than the originals.
REDELIVERY_S = DAY


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _uuid(kind: str, number: str):
    return F.concat(F.lit(f"00000000-0000-4000-{kind}-"), F.lpad(F.col(number).cast("string"), 12, "0"))


def events_as_logs(events: DataFrame) -> DataFrame:
    """The mapping, for a batch or a streaming read of the ``events`` table."""
    service = F.element_at(
        F.array(*[F.lit(s) for s in ("checkout", "auth", "payments", "inventory")]),
        (F.col("user_id") % 4 + 1).cast("int"),
    )
    kind = F.col("event_type")
    failure = F.element_at(
        F.array(F.lit(500), F.lit(502), F.lit(503)), (F.col("event_id") % 3 + 1).cast("int")
    )
    status = (
        F.when(kind == "error", failure)
        .when((kind == "signup") & (F.col("event_id") % 5 == 0), F.lit(404))
        .otherwise(F.lit(200))
    )
    part = F.element_at(
        F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("event_id") % 3 + 1).cast("int")
    )
    ts = F.col("ts").cast("timestamp")
    base = events.withColumns({"service": service, "status_code": status, "ts": ts})
    return base.select(
        _uuid("8000", "event_id").alias("event_id"),
        "ts",
        "service",
        F.concat(F.lit("/"), "service", F.lit("/"), part).alias("endpoint"),
        level_from_status(F.col("status_code")).alias("level"),
        F.col("status_code").cast("int").alias("status_code"),
        F.col("value").alias("latency_ms"),
        F.concat("service", F.lit(" handled "), kind).alias("message"),
        _uuid("9000", "user_id").alias("trace_id"),
        ((kind == "error") & (F.col("value") > 100)).alias("anomaly_injected"),
        (F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") % 900))).alias("ingested_at"),
    )


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_logs(_table(spark, sf_dir, "events"))


def redelivered(events: DataFrame) -> DataFrame:
    """Every event twice with the same key, errors a third time with a new
    timestamp (which makes that copy an event of its own)."""
    again = events.withColumn("message", F.concat("message", F.lit(" (again)"))).withColumn(
        "ingested_at", F.col("ingested_at") + F.make_dt_interval(secs=F.lit(REDELIVERY_S))
    )
    moved = events.filter(F.col("level") == "ERROR").withColumn(
        "ts", F.col("ts") + F.make_dt_interval(secs=F.lit(1))
    )
    return events.unionByName(again).unionByName(moved)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    service = F.expr(
        "CASE conv_id % 5 WHEN 0 THEN 'checkout' WHEN 1 THEN 'auth'"
        " WHEN 2 THEN 'payments' WHEN 3 THEN 'inventory' END"
    )
    hours = F.expr("CASE conv_id % 4 WHEN 1 THEN 0 WHEN 2 THEN 72 WHEN 3 THEN 720 END")
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"),
        F.col("text").alias("query"),
        service.alias("service"),
        hours.cast("int").alias("lookback_hours"),
        F.lit(AS_OF).cast("timestamp").alias("as_of"),
    )
