"""Session defaults and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    STATE_PROVIDER: ROCKSDB_PROVIDER,
    "spark.ui.enabled": "false",
    # Recording the call site of every column makes building plans slow.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "tidewatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this package's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the length of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of the file system that the path names, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme and host of its file system; one without goes to the default one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(place).toString()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the session's ``spark.checkpoint.dir``, with the scheme of its file system,
    so that tasks that open files there themselves see the place that Spark sees.

    Only a local session without that setting (tests) falls back to a
    temporary folder; a cluster must name one that every executor can reach.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        return f"file:{tempfile.mkdtemp(prefix='tidewatch-')}/{purpose}-{uuid.uuid4().hex}"
    return qualified(spark, f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}")
