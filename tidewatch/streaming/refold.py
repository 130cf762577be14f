"""Error-rate baseline from chunk maps, which late readings change in place.

A reading moves the baseline by an affine map, and so does a chunk of readings. The state is
one map per (service, chunk) and the readings themselves by chunk. Readings behind the last one
of their chunk extend its map. A reading before that changes the map of its own chunk, whose readings
are folded again; later chunks are composed anew from their stored maps, and only those whose
incoming baseline differs then are folded again too. The result is that of in-order delivery.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DetectSettings
from ..functions.times import ORIGIN_S, steps_down
from ..operators.ewma import chunked, folded_from, incoming
from ..session import remove

MAPS = "service string, chunk bigint, a double, b double, first double, last_bucket timestamp"
STORED = "service string, bucket timestamp, rate double, chunk bigint, batch bigint"
OUTPUT = ["service", "bucket", "rate", "ewma"]
VERSIONS = "service string, bucket timestamp, rate double, ewma double, batch bigint"
KEY = ["service", "chunk"]


def maps_place(state_path: str, batch_id: int) -> str:
    return f"{state_path}/before={batch_id}"


def read_maps(spark: SparkSession, state_path: str, batch_id: int) -> DataFrame:
    """The chunk maps before a batch. Only the first batch may find none."""
    try:
        return spark.read.schema(MAPS).parquet(maps_place(state_path, batch_id))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        if batch_id:
            raise RuntimeError(f"the state before batch {batch_id} is missing: {state_path}") from e
        return spark.createDataFrame([], MAPS)


def stored_readings(spark: SparkSession, state_path: str, chunks: DataFrame, batch_id: int) -> DataFrame:
    """Readings of the batches before this one in the given (service, chunk) pairs.

    Only the folders of those chunks are opened; their numbers, one per chunk of time and
    not per service, come to the driver.
    """
    numbers = sorted(r.chunk for r in chunks.select("chunk").distinct().collect())
    if not numbers:
        return spark.createDataFrame([], STORED).drop("batch")
    root = f"{state_path}/readings"
    rows = spark.read.schema(STORED).option("basePath", root).parquet(*[f"{root}/chunk={n}" for n in numbers])
    return rows.filter(F.col("batch") < batch_id).drop("batch").join(chunks, KEY, "left_semi")


def _points(readings: DataFrame) -> DataFrame:
    return readings.select("service", "chunk", "bucket", "rate", F.lit(True).alias("eligible"))


def refold_batch(
    readings: DataFrame, batch_id: int, state_path: str, out_path: str, settings: DetectSettings,
) -> None:
    """Folds a batch of (service, bucket, rate) in any order and writes the baselines that are new or moved.

    The first delivery of a (service, bucket) counts; of several in one batch the smallest rate.
    Later ones are not folded; ``repeats`` counts them. Readings without a rate are left out.
    All that a batch writes has its number, so a repeated batch writes the same rows.
    """
    spark, alpha = readings.sparkSession, settings.ewma_alpha
    maps = read_maps(spark, state_path, batch_id)
    secs = F.unix_seconds("bucket") - F.lit(ORIGIN_S)
    given = (
        readings.filter("rate is not null").groupBy("service", "bucket")
        .agg(F.min("rate").alias("rate"), F.count("*").alias("copies"))
        .withColumn("chunk", steps_down(secs, settings.chunk_s).cast("long"))
    ).persist()
    kept = [given]
    try:
        behind = given.join(maps.select(*KEY, "last_bucket"), KEY).filter("bucket <= last_bucket")
        opened = behind.select(*KEY).distinct().persist()
        kept.append(opened)
        before = stored_readings(spark, state_path, opened, batch_id)
        fresh = given.join(before.select("service", "bucket"), ["service", "bucket"], "left_anti").persist()
        kept.append(fresh)
        (
            fresh.select("service", "bucket", "rate", "chunk", F.lit(batch_id).cast("long").alias("batch"))
            .repartition("chunk").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("chunk", "batch").parquet(f"{state_path}/readings")
        )
        # A chunk that is only extended goes on from its map, an opened one is folded from its start.
        base = maps.join(opened, KEY, "left_anti").select(
            *KEY, F.col("a").alias("a0"), F.col("b").alias("b0"), F.col("first").alias("first0"),
        )
        points = _points(fresh).unionByName(_points(before))
        since = fresh.groupBy(*KEY).agg(F.min("bucket").alias("since"))
        pieces = chunked(points, alpha).join(since, KEY).join(base, KEY, "left").persist()
        kept.append(pieces)
        last = F.array_max(F.flatten("slices")["bucket"])
        changed = pieces.select(
            *KEY, (F.col("a") * F.coalesce("a0", F.lit(1.0))).alias("a"),
            (F.col("a") * F.coalesce("b0", F.lit(0.0)) + F.col("b")).alias("b"),
            F.coalesce("first0", "first").alias("first"), last.alias("last_bucket"),
        )
        after = maps.join(changed.select(*KEY), KEY, "left_anti").unionByName(changed)
        after.write.mode("overwrite").parquet(maps_place(state_path, batch_id + 1))
        after = read_maps(spark, state_path, batch_id + 1)
        services = changed.select("service").distinct()
        starts = incoming(after.join(services, "service", "left_semi"))
        old = incoming(maps.join(services, "service", "left_semi")).withColumnRenamed("b_in", "b_old")
        whole = opened.join(changed.select(*KEY), KEY, "left_semi")
        moved = (
            starts.join(old, KEY).filter("b_in <> b_old").join(whole, KEY, "left_anti").select(*KEY, "b_in").persist()
        )
        kept.append(moved)
        later = chunked(_points(stored_readings(spark, state_path, moved.select(*KEY), batch_id)), alpha)
        begun = F.coalesce(F.col("a0") * F.col("b_in") + F.col("b0"), F.col("b_in"))
        own = folded_from(pieces.join(starts, KEY).withColumn("b_in", begun), alpha)
        shifted = starts.join(old, KEY, "left").select(*KEY, F.col("b_in").eqNullSafe(F.col("b_old")).alias("same"))
        own = own.join(since, KEY).join(shifted, KEY).filter("bucket >= since or not same")
        scored = own.select(*OUTPUT).unionByName(
            folded_from(later.join(moved, KEY), alpha).select(*OUTPUT)
        )
        scored.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        copies = given.select("service", "bucket", "copies").join(
            fresh.select("service", "bucket", F.lit(1).alias("taken")), ["service", "bucket"], "left")
        again = copies.groupBy("service").agg(F.sum(F.col("copies") - F.coalesce("taken", F.lit(0))).alias("repeats"))
        again.filter("repeats > 0").write.mode("overwrite").parquet(f"{state_path}/repeats/batch={batch_id}")
        # This batch may be repeated and needs its own state; the one before it is done with.
        remove(spark, maps_place(state_path, batch_id - 1))
    finally:
        for frame in kept:
            frame.unpersist()


def current_baselines(spark: SparkSession, out_path: str) -> DataFrame:
    """The baseline each reading met, as it is known now: of each (service, bucket) the last version."""
    versions = spark.read.schema(VERSIONS).parquet(out_path)
    last = versions.groupBy("service", "bucket").agg(F.max_by(F.struct("rate", "ewma"), "batch").alias("v"))
    return last.select("service", "bucket", "v.*")


def repeats(spark: SparkSession, state_path: str) -> DataFrame:
    """Readings per service and batch that were delivered before, which are not folded again."""
    return spark.read.schema("service string, repeats bigint, batch int").parquet(f"{state_path}/repeats")
