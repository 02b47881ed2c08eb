"""Where streams keep their state."""

from __future__ import annotations

from pyspark.sql import SparkSession

STORE = "spark.sql.streaming.stateStore.providerClass"
HEAP_STORE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
COUNT_KEYS = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
ROCKSDB_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep stream state on disk, in sorted runs with Bloom filters, unless the session names a store of its own.

    A batch commits its changes; whole snapshots are stored in the background. The keys held are not counted,
    as that looks every key up once more when it is written.
    """
    if spark.conf.get(STORE, None) in (None, HEAP_STORE):
        spark.conf.set(STORE, ROCKSDB_STORE)
        spark.conf.set(CHANGELOG, "true")
        spark.conf.set(COUNT_KEYS, "false")
