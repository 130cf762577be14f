"""Helpers shared by the operators on large texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove, setting, shared_dir

#: Without it shuffle files stay until the driver happens to collect its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of long texts that one Arrow batch may hold.
TEXT_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Writes rows to the shared folder and reads them back: a cut in the lineage that
    outlives lost executors."""
    return stored_at(df, purpose)[0]


def stored_at(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """stored(), and where the rows are, for session.remove(). What was shuffled for them goes when they are written."""
    path = shared_dir(df.sparkSession, purpose)
    with setting(df.sparkSession, DROP_SHUFFLES, "true"):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


@contextmanager
def stored_within(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """stored() for rows that are needed in a block only: their folders go at its end."""
    paths = []

    def store(df: DataFrame, purpose: str) -> DataFrame:
        rows, path = stored_at(df, purpose)
        paths.append(path)
        return rows

    try:
        yield store
    finally:
        for path in paths:
            remove(spark, path)


def map_texts(df: DataFrame, batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    """mapInArrow with few rows to a batch, as any of them may be a very long text."""
    conf = df.sparkSession.conf
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= TEXT_ROWS:
        conf.set(key, str(TEXT_ROWS))
    return df.mapInArrow(batches, schema)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
    )


def training_row(doc_id: Column | str) -> Column:
    """Whether labels of a document may be learnt from: crc32 of its id mod 5 is not 0."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % 5 != 0


def bitmap_of(rows: DataFrame, place: Column, bits: int) -> bytes:
    """2**bits bits, of which those at the rows' places are set; built by Spark, so the driver has only the result."""
    at = place + 1  # the functions count buckets of 32,768 from 1
    parts = rows.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")
    )
    raw = bytearray(max(1 << bits, 32_768) // 8)
    for row in parts.toLocalIterator():
        raw[(row.k - 1) * 4096:row.k * 4096] = row.bits
    return bytes(raw)
