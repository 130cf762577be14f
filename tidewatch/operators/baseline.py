"""Trailing baselines per service, computed in time chunks.

A service's series is one group of a window, and a few services mean a few
tasks. So every bucket is placed in its own time chunk, and the last ``window_s``
of a chunk is also copied to the next one as a halo. The trailing window of any
bucket then lies inside one (service, chunk) group of bounded size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DetectSettings
from ..functions.scoring import burst_rate
from ..functions.times import ORIGIN_S, steps_down

# Buckets of history needed before a service is judged at all.
MIN_HISTORY = 2


def trailing_baseline(
    buckets: DataFrame, settings: DetectSettings, min_history: int = MIN_HISTORY
) -> DataFrame:
    """Each bucket with the statistics of the buckets in [bucket - window, bucket).

    Adds ``history`` (bucket count), ``p95_mean``, ``p95_stddev``, ``max_mean``,
    ``max_stddev`` (NULL values left out, 0 deviation below two values), ``rate``
    and ``eligible``, and keeps the chunk number in ``chunk``.
    """
    chunk_s = settings.chunk_s
    secs = F.unix_seconds("bucket") - F.lit(ORIGIN_S)
    home = steps_down(secs, chunk_s)
    near_next = F.pmod(secs, F.lit(chunk_s)) >= chunk_s - settings.window_s
    homes = F.when(near_next, F.array(home, home + 1)).otherwise(F.array(home))
    placed = (
        buckets.withColumn("_secs", secs)
        .withColumn("chunk", F.explode(homes))
        .withColumn("_home", home)
    )
    w = (
        Window.partitionBy("service", "chunk")
        .orderBy("_secs")
        .rangeBetween(-settings.window_s, -1)
    )
    scored = placed.withColumns(
        {
            "history": F.count("*").over(w),
            "p95_mean": F.coalesce(F.avg("p95_latency_ms").over(w), F.lit(0.0)),
            "p95_stddev": F.coalesce(F.stddev_samp("p95_latency_ms").over(w), F.lit(0.0)),
            "max_mean": F.coalesce(F.avg("max_latency_ms").over(w), F.lit(0.0)),
            "max_stddev": F.coalesce(F.stddev_samp("max_latency_ms").over(w), F.lit(0.0)),
        }
    )
    return scored.filter(F.col("chunk") == F.col("_home")).select(
        *buckets.columns,
        "chunk", "history", "p95_mean", "p95_stddev", "max_mean", "max_stddev",
        burst_rate(F.col("event_count"), F.col("error_count")).alias("rate"),
        (F.col("history") >= min_history).alias("eligible"),
    )
