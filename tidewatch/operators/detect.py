"""Anomalies from rollup buckets: two latency z-scores and the error burst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DetectSettings
from ..functions.scoring import burst_rate, ewma_z, severity_both_ways, severity_upward, z_score
from ..functions.times import seconds_before
from ..schemas import ANOMALIES
from .baseline import MIN_HISTORY, trailing_baseline
from .ewma import with_error_baseline

LATENCY_SPIKE = "latency_spike"
MAX_LATENCY_OUTLIER = "max_latency_outlier"
ERROR_BURST = "error_burst"

DEFAULTS = DetectSettings()
FINDING = ["bucket_ts", "service", "anomaly_type", "metric_value", "baseline_mean",
           "baseline_stddev", "z_score", "severity"]


def _finding(kind: str, value: Column, mean: Column, stddev: Column, z: Column,
             severity: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("anomaly_type"),
        value.alias("metric_value"),
        mean.alias("baseline_mean"),
        stddev.alias("baseline_stddev"),
        z.alias("z_score"),
        severity.alias("severity"),
    )


def _latency_finding(kind: str, metric: str, prefix: str, s: DetectSettings) -> Column:
    value, mean, stddev = F.col(metric), F.col(f"{prefix}_mean"), F.col(f"{prefix}_stddev")
    z = z_score(value, mean, stddev)
    return _finding(kind, value, mean, stddev, z, severity_upward(z, s.z_warning, s.z_critical))


def _error_finding(s: DetectSettings) -> Column:
    z = F.col("ewma_z")
    return _finding(
        ERROR_BURST, F.col("rate"), F.col("ewma"), F.lit(0.0), z,
        severity_both_ways(z, s.z_warning, s.z_critical),
    )


def _findings(scored: DataFrame, kinds: list[Column]) -> DataFrame:
    """All detectors in one pass over the rows: the union of their findings."""
    judged = scored.filter(F.col("eligible")).select(
        F.col("bucket").alias("bucket_ts"), "service", F.inline(F.array(*kinds))
    )
    return judged.filter(F.col("severity").isNotNull()).select(*FINDING)


def _p95(s: DetectSettings) -> Column:
    return _latency_finding(LATENCY_SPIKE, "p95_latency_ms", "p95", s)


def _max(s: DetectSettings) -> Column:
    return _latency_finding(MAX_LATENCY_OUTLIER, "max_latency_ms", "max", s)


def latency_spikes(buckets: DataFrame, s: DetectSettings = DEFAULTS) -> DataFrame:
    return _findings(trailing_baseline(buckets, s), [_p95(s)])


def max_latency_outliers(buckets: DataFrame, s: DetectSettings = DEFAULTS) -> DataFrame:
    return _findings(trailing_baseline(buckets, s), [_max(s)])


def score(
    buckets: DataFrame, s: DetectSettings = DEFAULTS, state: DataFrame | None = None
) -> DataFrame:
    """Buckets with every baseline the detectors read."""
    return with_error_baseline(trailing_baseline(buckets, s), s.ewma_alpha, state)


def error_bursts(buckets: DataFrame, s: DetectSettings = DEFAULTS) -> DataFrame:
    return _findings(score(buckets, s), [_error_finding(s)])


def latency_findings(baselined: DataFrame, s: DetectSettings = DEFAULTS) -> DataFrame:
    """Findings of the two latency detectors, which need no error baseline."""
    return _findings(baselined, [_p95(s), _max(s)])


def findings(scored: DataFrame, s: DetectSettings = DEFAULTS) -> DataFrame:
    """Findings of all three detectors over scored buckets."""
    return _findings(scored, [_p95(s), _max(s), _error_finding(s)])


def detect(buckets: DataFrame, s: DetectSettings = DEFAULTS) -> DataFrame:
    """Replay: every bucket judged once against the window before it."""
    return findings(score(buckets, s), s)


def closed(as_of, s: DetectSettings = DEFAULTS) -> Column:
    """Whether a bucket has ended by ``as_of``."""
    return F.col("bucket") <= seconds_before(as_of, s.width_s)


def current_and_history(buckets: DataFrame, as_of, s: DetectSettings = DEFAULTS) -> DataFrame:
    """Each service's newest closed bucket in the window, with the others as baseline.

    A bucket is closed at its end, which is ``width_s`` after its start.
    The window holds at most ``window_s / width_s`` buckets of a service.
    """
    recent = buckets.filter(
        (F.col("bucket") >= seconds_before(as_of, s.window_s))
        & closed(as_of, s)
    )
    newest = Window.partitionBy("service").orderBy(F.col("bucket").desc())
    before = Window.partitionBy("service").orderBy(F.col("bucket").desc()).rowsBetween(
        1, Window.unboundedFollowing
    )
    zero = F.lit(0.0)
    split = recent.withColumns(
        {
            "_age": F.row_number().over(newest),
            "history": F.count("*").over(before),
            "p95_mean": F.coalesce(F.avg("p95_latency_ms").over(before), zero),
            "p95_stddev": F.coalesce(F.stddev_samp("p95_latency_ms").over(before), zero),
            "max_mean": F.coalesce(F.avg("max_latency_ms").over(before), zero),
            "max_stddev": F.coalesce(F.stddev_samp("max_latency_ms").over(before), zero),
        }
    )
    return split.filter(F.col("_age") == 1).select(
        *buckets.columns, "history", "p95_mean", "p95_stddev", "max_mean", "max_stddev",
        burst_rate(F.col("event_count"), F.col("error_count")).alias("rate"),
        (F.col("history") >= MIN_HISTORY).alias("eligible"),
    )


def snapshot(
    buckets: DataFrame, as_of, s: DetectSettings = DEFAULTS, state: DataFrame | None = None
) -> DataFrame:
    """One polling cycle at ``as_of``: only each service's newest bucket is judged.

    ``state`` holds (service, ewma) from earlier cycles; without it the error
    baseline is what a replay up to ``as_of`` gives.
    """
    current = current_and_history(buckets, as_of, s)
    if state is None:
        past = buckets.filter(closed(as_of, s))
        state = score(past, s).select("service", "bucket", "ewma")
        joined = current.join(state, ["service", "bucket"], "left")
    else:
        joined = current.join(state.select("service", "ewma"), "service", "left")
    # A service without a baseline starts from its own reading.
    baseline = F.when(F.col("eligible"), F.coalesce("ewma", "rate"))
    scored = joined.withColumn("ewma", baseline).withColumn(
        "ewma_z", ewma_z(F.col("rate"), F.col("ewma"))
    )
    return findings(scored, s)


def as_records(findings: DataFrame, detected_at, random_ids: bool = False) -> DataFrame:
    """Findings as rows of the anomaly table.

    The id is derived from what was found, so a retried or repeated run writes
    the same rows; ``random_ids`` gives a new one each time instead.
    """
    stamp = F.date_format("bucket_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    derived = F.sha2(F.concat_ws("|", "service", stamp, "anomaly_type"), 256)
    when = detected_at if isinstance(detected_at, Column) else F.lit(detected_at)
    return findings.select(
        (F.uuid() if random_ids else derived).alias("id"),
        when.cast("timestamp").alias("detected_at"),
        *FINDING,
    ).select(*ANOMALIES.fieldNames())


def anomaly_counts(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("service", "anomaly_type", "severity").agg(
        F.count("*").alias("anomalies")
    )
