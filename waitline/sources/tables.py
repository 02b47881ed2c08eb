"""Batch tables: plain Parquet folders with full refresh by versioned write."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waitline.sources.session import shared_folder

MARKER = "_current"


def workspace(spark: SparkSession) -> str:
    """A fresh folder under the cluster's shared folder."""
    return f"{shared_folder(spark)}/waitline-{uuid.uuid4().hex}"


def _store(df: DataFrame) -> str:
    folder = workspace(df.sparkSession)
    df.write.parquet(folder)
    discard_later(df.sparkSession, folder)
    return folder


def stage(df: DataFrame) -> DataFrame:
    """Store a costly intermediate table and read it back, so that later steps that use it
    several times do not compute it again and a lost executor does not restart the chain.

    The folder goes when the application ends."""
    return df.sparkSession.read.schema(df.schema).parquet(_store(df))


def discard_later(spark: SparkSession, folder: str) -> None:
    """Delete a staged folder when the application ends: on exit of its file system, which ends with the JVM.

    It is made if need be, as a folder that is not there yet would not be noted for deletion."""
    _, target, fs = _filesystem(spark, folder)
    fs.mkdirs(target)
    fs.deleteOnExit(target)


def discard(spark: SparkSession, *folders: str) -> None:
    """Delete folders that nothing reads any more."""
    for folder in folders:
        _, target, fs = _filesystem(spark, folder)
        fs.delete(target, True)


BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 16 << 20


def lookup(df: DataFrame) -> DataFrame:
    """Store a per-key table and mark it for broadcast only if what is stored is few rows and few bytes.

    Beyond the limits it stays an ordinary join side, which adaptive execution splits on skew.
    """
    folder = _store(df)
    stored = df.sparkSession.read.schema(df.schema).parquet(folder)
    _, target, fs = _filesystem(df.sparkSession, folder)
    small = fs.getContentSummary(target).getLength() <= BROADCAST_BYTES and stored.count() <= BROADCAST_ROWS
    return F.broadcast(stored) if small else stored


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, target, fs = _filesystem(spark, path)
    return fs.exists(target)


def read_marker(spark: SparkSession, root: str) -> dict | None:
    """Small JSON note naming the folder readers should use, or None before the first write."""
    _, target, fs = _filesystem(spark, f"{root}/{MARKER}")
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def write_marker(spark: SparkSession, root: str, note: dict) -> None:
    """Put a new note in place of the old one in a single rename: readers see either, never none."""
    jvm, target, fs = _filesystem(spark, f"{root}/{MARKER}")
    draft = jvm.org.apache.hadoop.fs.Path(f"{root}/{MARKER}.{uuid.uuid4().hex}")
    stream = fs.create(draft, True)
    stream.write(bytearray(json.dumps(note).encode()))
    stream.close()
    fs_jvm = jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(fs_jvm.Options.Rename, 1)
    options[0] = fs_jvm.Options.Rename.OVERWRITE
    fs_jvm.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, target, options)


def versions(spark: SparkSession, root: str) -> list[int]:
    """Version folders under a table's root, complete or not."""
    _, target, fs = _filesystem(spark, root)
    if not fs.exists(target):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(target)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def refresh(df: DataFrame, root: str) -> str:
    """Replace a table's content and schema: write a new version, then point readers at it.

    The number follows from the folders that are there, so a version that was half written or whose
    marker was lost is never written into, and readers of an older version keep their files.
    """
    spark = df.sparkSession
    version = max([0, *versions(spark, root)]) + 1
    folder = f"{root}/v{version:06d}"
    df.write.parquet(folder)
    write_marker(spark, root, {"version": version, "folder": folder})
    return folder


def current(spark: SparkSession, root: str) -> DataFrame:
    note = read_marker(spark, root)
    if note is None:
        raise FileNotFoundError(f"no table at {root}")
    return spark.read.parquet(note["folder"])


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First n rows in a given order (planned as a top-k, never a full sort)."""
    return df.orderBy(*[F.col(c) for c in order]).limit(n)
