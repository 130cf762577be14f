"""Date-partitioned Parquet tables with keyed, repeatable inserts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.keys import first_arrivals, without_known_keys
from ..schemas import ANOMALIES, ANOMALY_VERSIONS, LOG_EVENT_KEY, LOG_EVENTS, ROLLUP, ROLLUP_KEY, with_partition

# Partition dates listed one by one in a filter, each with its span of times;
# with more of them the filter is the range from the first date to the last.
MAX_LISTED_DATES = 100


class Table:
    """A stored table: declared schema, date partition, key and file order.

    A key that contains the partition's time can only clash within a date. For
    other keys ``not_before`` names a column whose date is never after the
    partition date of a row with the same key.
    """

    def __init__(self, schema: StructType, time_column: str, partition: str,
                 keys: list[str], order: list[str], not_before: str | None = None):
        self.schema = schema
        self.time_column = time_column
        self.partition = partition
        self.keys = keys
        self.order = order
        self.not_before = not_before

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        """Typed scan including the partition column; no rows before the first write."""
        stored = with_partition(self.schema, self.partition)
        try:
            return spark.read.schema(stored).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], stored)

    def day(self) -> Column:
        return F.to_date(self.time_column)

    def write(self, rows: DataFrame, path: str, mode: str = "append", **options) -> None:
        """Writes by date. Rebalancing splits a date with very many rows over
        several files and packs small ones; files are sorted for scan pruning."""
        (
            rows.select(*self.schema.fieldNames())
            .withColumn(self.partition, self.day())
            .hint("rebalance", self.partition)
            .sortWithinPartitions(self.partition, *self.order)
            .write.mode(mode)
            .options(**options)
            .partitionBy(self.partition)
            .parquet(path)
        )

    def touched(self, stored: DataFrame, rows: DataFrame) -> DataFrame:
        """The part of ``stored`` that can hold keys of ``rows``.

        When the key contains the time, that is the span of times that ``rows``
        has in each date: partitions are pruned by date and row groups by time,
        so a small batch does not read the whole day again. Only dates and spans
        reach the driver, no more than the listing limit.
        """
        partition, time = F.col(self.partition), F.col(self.time_column)
        if self.not_before:
            oldest = rows.agg(F.min(F.to_date(self.not_before))).first()[0]
            return stored.filter(partition >= F.lit(oldest))
        micros = F.unix_micros(time)
        spans = rows.groupBy(self.day().alias("day")).agg(
            F.min(micros).alias("a"), F.max(micros).alias("b")
        )
        listed = spans.limit(MAX_LISTED_DATES + 1).collect()
        if not listed:
            return stored.filter(F.lit(False))
        if len(listed) > MAX_LISTED_DATES:
            ends = spans.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
            return stored.filter(partition.between(ends.a, ends.b))
        inside = F.lit(False)
        for span in listed:
            first, last = (F.timestamp_micros(F.lit(us)) for us in (span.a, span.b))
            inside = inside | ((partition == span.day) & time.between(first, last))
        return stored.filter(inside)

    def insert_new(self, rows: DataFrame, path: str, arrival: list[str]) -> None:
        """Keyed insert: the first arrival of an unknown key is written, the rest
        ignored. Running it again with the same rows changes nothing.
        """
        names = self.schema.fieldNames()
        # Other columns break ties, so that a recomputed task picks the same copy.
        rest = [n for n in names if n not in (*self.keys, *arrival)]
        stored = self.touched(self.read(rows.sparkSession, path), rows)
        unique = first_arrivals(rows, [*arrival, *rest], self.keys)
        self.write(without_known_keys(unique, stored, self.keys), path)

    def replace(self, rows: DataFrame, path: str) -> None:
        """Replaces the rows with the same keys, rewriting the touched dates.

        Every touched date is rewritten whole, so the list of dates is no longer
        than the work itself.
        """
        days = [r.d for r in rows.select(self.day().alias("d")).distinct().collect()]
        if not days:
            return
        stored = self.read(rows.sparkSession, path).filter(F.col(self.partition).isin(days))
        names = self.schema.fieldNames()
        kept = without_known_keys(stored, rows, self.keys).select(*names)
        merged = kept.unionByName(rows.select(*names))
        self.write(merged, path, mode="overwrite", partitionOverwriteMode="dynamic")


EVENTS_TABLE = Table(LOG_EVENTS, "ts", "event_date", LOG_EVENT_KEY, ["service", "ts"])
ROLLUP_TABLE = Table(ROLLUP, "bucket", "bucket_date", ROLLUP_KEY, ["service", "bucket"])
# A bucket is judged after it has begun.
ANOMALY_TABLE = Table(
    ANOMALIES, "detected_at", "detected_date", ["id"], ["service", "detected_at"],
    not_before="bucket_ts",
)


# The id of a finding has its bucket in it.
VERSION_TABLE = Table(
    ANOMALY_VERSIONS, "bucket_ts", "bucket_date", ["id", "version"], ["service", "bucket_ts"], not_before="bucket_ts",
)


def versions_path(anomalies_path: str) -> str:
    return f"{anomalies_path.rstrip('/')}_versions"


def latest(first: DataFrame, versions: DataFrame) -> DataFrame:
    """Findings as they are judged now: of each id the last version, unless withdrawn."""
    names = ANOMALIES.fieldNames()
    start = first.select(*names, F.lit(-1).cast("long").alias("version"), F.lit(False).alias("withdrawn"))
    every = start.unionByName(versions.select(*ANOMALY_VERSIONS.fieldNames()))
    last = every.groupBy("id").agg(F.max_by(F.struct(*names, "withdrawn"), "version").alias("v"))
    return last.filter(~F.col("v.withdrawn")).select("v.*").drop("withdrawn")


def current_anomalies(spark: SparkSession, anomalies_path: str) -> DataFrame:
    """The anomaly table with the findings that later buckets changed."""
    return latest(ANOMALY_TABLE.read(spark, anomalies_path), VERSION_TABLE.read(spark, versions_path(anomalies_path)))


def insert_events(events: DataFrame, path: str, arrival: list[str] | None = None) -> None:
    EVENTS_TABLE.insert_new(events, path, arrival or ["ingested_at"])


def insert_anomalies(records: DataFrame, path: str) -> None:
    ANOMALY_TABLE.insert_new(records, path, ["bucket_ts"])
