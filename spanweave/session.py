"""Session settings and shared working folders."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import SparkSession

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_SETTINGS = {
    # Times without a zone are read and written as UTC everywhere.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # transformWithState keeps its state in RocksDB (on disk, not on the heap).
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # A stream-stream join keeps one RocksDB per partition instead of four.
    "spark.sql.streaming.join.stateFormatVersion": "3",
    # Checkpoint files rely on the checksums of the file system; own ones double their number.
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
    # Session windows combine inside a partition before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def prepare_session(spark: SparkSession) -> SparkSession:
    """Apply the settings the library relies on to ``spark`` and return it."""
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    The cluster names it in ``spark.checkpoint.dir``. A session without that setting uses a folder
    below its warehouse, which executors reach as well, wherever the session runs.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/spanweave-{uuid.uuid4().hex}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no earlier run has used."""
    return f"{shared_root(spark)}/spanweave/{label}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting that holds for what is started inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def state_partitions(spark: SparkSession, count: int | None = None) -> AbstractContextManager[None]:
    """Use ``count`` shuffle partitions (default: one per core) for queries started inside.

    A stateful stream fixes its partition count in the checkpoint and is not re-planned by
    AQE, so the count is chosen here rather than left at the batch default.
    """
    return setting(spark, "spark.sql.shuffle.partitions", str(count or spark.sparkContext.defaultParallelism))
