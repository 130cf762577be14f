"""Detection over a stream of closed rollup buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DetectSettings
from ..functions.times import seconds_before
from ..operators.baseline import trailing_baseline
from ..operators.detect import ERROR_BURST, anomaly_counts, as_records, findings, latency_findings
from ..operators.ewma import final_state, with_error_baseline
from ..operators.filters import on_or_after
from ..schemas import ROLLUP
from ..sources.tables import ROLLUP_TABLE, VERSION_TABLE, current_anomalies, insert_anomalies, versions_path
from .counters import grouped, record
from .ewma import read_state, report_late, with_lateness, write_state

DEFAULTS = DetectSettings()


def detect_batch(
    buckets: DataFrame, batch_id: int, rollup_path: str, anomalies_path: str,
    state_path: str, settings: DetectSettings = DEFAULTS, detected_at=None,
    counters_path: str | None = None,
) -> None:
    """Judges newly closed buckets against the stored ones before them.

    History is read from the rollup table, one window before the oldest new
    bucket, for the services concerned. The error baseline goes on from the
    state written before this batch; the state after it has a folder of its
    own, so repeating a batch reads the same state and writes the same rows.

    A bucket that is not newer than its service's baseline came late or again.
    Its latencies are judged like those of any other, and the buckets whose window it
    enters are judged again (``rejudge``). Its error reading can no longer be folded
    in order and is counted in ``ewma.late_readings``.

    With ``counters_path`` the cycle, its buckets and its findings are counted there.
    """
    spark = buckets.sparkSession
    state = read_state(spark, state_path, batch_id)
    new = with_lateness(buckets.select(*ROLLUP.fieldNames()), state).persist()
    kept = [new]
    try:
        oldest, newest = new.agg(F.min("bucket"), F.max("bucket")).first()
        if oldest is None:
            write_state(state, state.limit(0), state_path, batch_id)
            return
        begin = seconds_before(oldest, settings.window_s)
        stored = on_or_after(ROLLUP_TABLE.read(spark, rollup_path), "bucket", begin).filter(
            (F.col("bucket") <= F.lit(newest))
            & (F.col(ROLLUP_TABLE.partition) <= F.to_date(F.lit(newest)))
        )
        keys = new.select("bucket", "service", "late")
        history = stored.select(*ROLLUP.fieldNames()).join(keys, ["bucket", "service"], "left_anti")
        together = history.unionByName(new.drop("late")).join(
            new.select("service").distinct(), "service", "left_semi"
        )
        baselined = trailing_baseline(together, settings).join(keys, ["bucket", "service"]).persist()
        kept.append(baselined)
        scored = with_error_baseline(
            baselined.filter("not late").drop("late"), settings.ewma_alpha, state
        ).persist()
        kept.append(scored)
        late = baselined.filter("late").drop("late")
        when = detected_at if detected_at is not None else F.current_timestamp()
        found = findings(scored, settings).unionByName(latency_findings(late, settings))
        records = as_records(found, when).persist()
        kept.append(records)
        insert_anomalies(records, anomalies_path)
        write_state(state, final_state(scored, settings.ewma_alpha), state_path, batch_id)
        report_late(late.filter("eligible and rate is not null"), state_path, batch_id)
        if not late.isEmpty():
            rejudge(new, state, batch_id, rollup_path, anomalies_path, settings, when)
        if counters_path:
            count_cycle(new, records, batch_id, counters_path)
    finally:
        for frame in kept:
            frame.unpersist()


def rejudge(
    new: DataFrame, state: DataFrame, batch_id: int, rollup_path: str, anomalies_path: str,
    settings: DetectSettings, when,
) -> None:
    """Judges the latencies of the buckets again that have a late bucket in their window.

    What is found now and was not, or with other values, is written as a new version of the
    finding, and what is no longer found as withdrawn. The version is the number of the batch, so
    a repeated batch writes nothing new.
    """
    spark = new.sparkSession
    late = new.filter("late").select("bucket", "service")
    steps = range(1, settings.window_s // settings.width_s + 1)
    moved = late.withColumn("_after", F.explode(F.array(*[F.lit(k * settings.width_s) for k in steps])))
    after = moved.select(
        "service", F.timestamp_seconds(F.unix_seconds("bucket") + F.col("_after")).alias("bucket")
    ).distinct()
    after = after.join(late, ["bucket", "service"], "left_anti")
    touched = with_lateness(after, state).filter("late").drop("late").persist()
    span = touched.agg(F.min("bucket"), F.max("bucket")).first()
    if span[0] is None:
        touched.unpersist()
        return
    begin = seconds_before(span[0], settings.window_s)
    stored = on_or_after(ROLLUP_TABLE.read(spark, rollup_path), "bucket", begin).filter(
        (F.col("bucket") <= F.lit(span[1])) & (F.col(ROLLUP_TABLE.partition) <= F.to_date(F.lit(span[1])))
    ).select(*ROLLUP.fieldNames())
    keys = new.select("bucket", "service")
    together = stored.join(keys, ["bucket", "service"], "left_anti").unionByName(new.drop("late")).join(
        late.select("service").distinct(), "service", "left_semi"
    )
    again = trailing_baseline(together, settings).join(touched, ["bucket", "service"], "left_semi")
    found = as_records(latency_findings(again, settings), when).persist()
    place = touched.select(F.col("bucket").alias("bucket_ts"), "service")
    known = current_anomalies(spark, anomalies_path).filter(
        (F.col("bucket_ts") >= F.lit(span[0])) & (F.col("bucket_ts") <= F.lit(span[1]))
    )
    known = known.filter(F.col("anomaly_type") != ERROR_BURST).join(place, ["bucket_ts", "service"], "left_semi").persist()
    values = ["metric_value", "baseline_mean", "baseline_stddev", "z_score", "severity"]
    before = known.select("id", F.struct(*values).alias("_before"))
    changed = found.join(before, "id", "left").filter(~F.struct(*values).eqNullSafe(F.col("_before"))).drop("_before")
    gone = known.join(found.select("id"), "id", "left_anti").withColumn("detected_at", F.lit(when).cast("timestamp"))
    versions = changed.withColumn("withdrawn", F.lit(False)).unionByName(gone.withColumn("withdrawn", F.lit(True)))
    versions = versions.withColumn("version", F.lit(batch_id).cast("long")).persist()
    try:
        VERSION_TABLE.insert_new(versions, versions_path(anomalies_path), ["bucket_ts"])
    finally:
        for frame in (versions, known, found, touched):
            frame.unpersist()


def count_cycle(new: DataFrame, records: DataFrame, batch_id: int, path: str) -> None:
    """Records a detection cycle: that it ran, its buckets and what it found."""
    found = grouped(anomaly_counts(records), "anomaly_detected_total", ["anomaly_type", "service", "severity"], "anomalies")
    record(
        new.sparkSession, path, "detect", batch_id, [("anomaly_detection_cycles_total", {}, 1.0)], [found],
        [("anomaly_buckets_fetched", {}, float(new.count()))],
    )


def start_detect(
    buckets: DataFrame, rollup_path: str, anomalies_path: str, state_path: str,
    checkpoint: str, settings: DetectSettings = DEFAULTS, poll_s: int = 15,
    available_now: bool = False, detected_at=None,
) -> StreamingQuery:
    """Starts detection on a stream of rollup rows."""

    def judge(batch: DataFrame, batch_id: int) -> None:
        detect_batch(
            batch, batch_id, rollup_path, anomalies_path, state_path, settings, detected_at
        )

    writer = buckets.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{poll_s} seconds").start()
