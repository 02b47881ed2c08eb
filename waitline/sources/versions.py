"""Log of a table's committed versions.

A table is a root folder. Every write goes to a folder of its own under `data/`, and becomes part of the table
when a note naming it is renamed into `_log/`. A version is committed once: a writer that comes second, or
again after a failure, leaves the table as it is. What a failed attempt has written is named by no note and
nobody reads it. Readers go by the notes alone, so they never see half a version, and streams follow by number.

Version numbers of an appended table are batch numbers, without gaps; a note names what its batch added.
The notes of a replaced table name all that a version consists of, so the last one is enough to read it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from waitline.sources.session import ship_package
from waitline.sources.tables import _filesystem, exists

LOG, DATA, LEASES = "_log", "data", "_leases"


def _note(version: int) -> str:
    return f"{LOG}/{version:012d}.json"


def committed(spark: SparkSession, root: str, version: int) -> bool:
    return exists(spark, f"{root}/{_note(version)}")


def _write(spark: SparkSession, path: str, note: dict) -> None:
    _, target, fs = _filesystem(spark, path)
    stream = fs.create(target, False)
    stream.write(bytearray(json.dumps(note).encode()))
    stream.close()


def _read(spark: SparkSession, path: str) -> dict:
    _, target, fs = _filesystem(spark, path)
    stream = fs.open(target)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _names(spark: SparkSession, folder: str) -> list[str]:
    _, target, fs = _filesystem(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(target)) if fs.exists(target) else []


def commit(spark: SparkSession, root: str, version: int, note: dict[str, Any]) -> bool:
    """Put a version's note into the log unless it is there; says whether this one came first."""
    if committed(spark, root, version):
        return False
    draft = f"{root}/{LOG}/.{uuid.uuid4().hex}"
    _write(spark, draft, {"version": version, **note})
    jvm, source, _ = _filesystem(spark, draft)
    _, target, _ = _filesystem(spark, f"{root}/{_note(version)}")
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:  # without the option to overwrite: of two writers one fails
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), hadoop).rename(source, target, plain)
    except Exception:
        if not committed(spark, root, version):
            raise
        return False
    return True


def versions(spark: SparkSession, root: str) -> list[int]:
    return [int(n[:-5]) for n in _names(spark, f"{root}/{LOG}") if n.endswith(".json") and n[:-5].isdigit()]


def latest(spark: SparkSession, root: str) -> int:
    """Number of the last version, -1 before the first."""
    return max(versions(spark, root), default=-1)


def note(spark: SparkSession, root: str, version: int) -> dict[str, Any]:
    return _read(spark, f"{root}/{_note(version)}")


def attempt(version: int) -> str:
    """A data folder no other attempt at a version writes to."""
    return f"{DATA}/{version:012d}-{uuid.uuid4().hex}"


# Appended tables ----------------------------------------------------------------------------

ROWS_PER_FILE = 500_000


def append(df: DataFrame, root: str, version: int) -> bool:
    """Add a batch's rows as a version; a batch that is committed is not written again.

    The rows are counted first, so a batch that is costly should be persisted. It is written as a file per core, or per
    so many rows, and not as one per state partition: a follower has a task for each file.
    """
    spark = df.sparkSession
    if committed(spark, root, version):
        return False
    rows = df.count()
    folder = attempt(version) if rows else None
    if folder:
        files = max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_FILE))
        df.coalesce(files).write.option("compression", "zstd").parquet(f"{root}/{folder}")
    return commit(spark, root, version, {"folder": folder})


def read(spark: SparkSession, root: str, schema: T.StructType | str) -> DataFrame:
    """All committed rows of an appended table. The log is read as a table, whatever the number of versions."""
    if latest(spark, root) < 0:
        return spark.createDataFrame([], schema)
    notes = spark.read.schema("version long, folder string").json(f"{root}/{LOG}")
    folders = [r["folder"] for r in notes.where("folder is not null").select("folder").collect()]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in sorted(folders)])


class _Files(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _arrow_filesystem(root: str):
    from pyarrow import fs

    if root.startswith("file:/") and "://" not in root:
        root = root[len("file:"):]
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


class _Follower(DataSourceStreamReader):
    """Offsets are version numbers: a micro-batch holds the files of the versions after one and up to another."""

    def __init__(self, root: str, schema: T.StructType):
        self.root, self.schema = root, schema

    def initialOffset(self) -> dict:
        return {"version": -1}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        files, base = _arrow_filesystem(self.root)
        found = files.get_file_info(fs.FileSelector(f"{base}/{LOG}", allow_not_found=True))
        names = {f.base_name for f in found}
        if not names:
            return {"version": -1}
        last = max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=-1)
        return {"version": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        from pyarrow import fs

        files, base = _arrow_filesystem(self.root)
        out: list[InputPartition] = []
        for version in range(start["version"] + 1, end["version"] + 1):
            with files.open_input_stream(f"{base}/{_note(version)}") as f:
                folder = json.loads(f.read())["folder"]
            if folder:
                found = files.get_file_info(fs.FileSelector(f"{base}/{folder}"))
                out += [_Files(f.path) for f in sorted(found, key=lambda f: f.path) if f.base_name.endswith(".parquet")]
        return out

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(self.schema)
        files, _ = _arrow_filesystem(self.root)
        with files.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f, coerce_int96_timestamp_unit="us").iter_batches(columns=wanted.names):
                # Instants are stored without their zone, which is UTC.
                columns = [batch[n].cast(pa.timestamp("us")).cast(t) if pa.types.is_timestamp(t) else batch[n].cast(t)
                           for n, t in zip(wanted.names, wanted.types)]
                yield pa.RecordBatch.from_arrays(columns, schema=wanted)


class CommittedVersions(DataSource):
    """Stream of an appended table's committed rows."""

    @classmethod
    def name(cls) -> str:
        return "committed_versions"

    def schema(self) -> str:
        raise ValueError("give the table's schema")

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _Follower(self.options["root"], schema)


#: Lets Spark drain a source written in Python batch by batch, with the last one that moves the watermark on.
#: Safe for sources whose offsets only grow.
DRAIN = "spark.sql.streaming.triggerAvailableNowWrapper.enabled"


def register(spark: SparkSession, source: type[DataSource]) -> None:
    ship_package(spark)
    spark.conf.set(DRAIN, "true")
    spark.dataSource.register(source)


def follow(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Follow an appended table: each version once, in order, and nothing that is not committed."""
    register(spark, CommittedVersions)
    return spark.readStream.format("committed_versions").schema(schema).option("root", root).load()


# Replaced tables ----------------------------------------------------------------------------

@contextmanager
def lease(spark: SparkSession, root: str, seconds: int = 3600) -> Iterator[dict[str, Any]]:
    """The last version's note; while the block runs, `expire` keeps that version's files.

    A reader that dies holds them for some seconds more, not for ever.
    """
    path = f"{root}/{LEASES}/{uuid.uuid4().hex}.json"
    while True:
        version = latest(spark, root)
        _write(spark, path, {"version": version, "until": time.time() + seconds})
        if version < 0 or committed(spark, root, version):  # not expired between the two steps
            break
        _filesystem(spark, path)[2].delete(_filesystem(spark, path)[1], False)
    try:
        if version < 0:
            raise FileNotFoundError(f"no table at {root}")
        yield note(spark, root, version)
    finally:
        _, target, fs = _filesystem(spark, path)
        fs.delete(target, False)


def _folders(value: Any) -> set[str]:
    """Data folders that a note names, wherever they stand in it."""
    if isinstance(value, str):
        return {value} if value.startswith(f"{DATA}/") else set()
    children = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return set().union(*map(_folders, children))


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Forget all but the last `keep` versions and those under a lease; delete files that no remaining one names.

    Folders of attempts at versions to come are left alone.
    """
    known = versions(spark, root)
    held = set(known[-keep:])
    for name in _names(spark, f"{root}/{LEASES}"):
        try:
            given = _read(spark, f"{root}/{LEASES}/{name}")
        except Exception:  # released in between
            continue
        if given["until"] > time.time():
            held.add(given["version"])
    gone = [v for v in known if v not in held]
    for v in gone:  # first the notes: a reader takes a lease before it reads one
        _, target, fs = _filesystem(spark, f"{root}/{_note(v)}")
        fs.delete(target, False)
    needed = set().union(*[_folders(note(spark, root, v)) for v in known if v in held])
    last = known[-1] if known else -1
    for name in _names(spark, f"{root}/{DATA}"):
        folder = f"{DATA}/{name}"
        if int(name.split("-")[0]) > last:
            continue
        inner = {n for n in needed if n == folder or n.startswith(f"{folder}/")}
        if folder in inner:
            continue
        doomed = [folder] if not inner else [f"{folder}/{n}" for n in _names(spark, f"{root}/{folder}")
                                             if not n.startswith(("_", ".")) and f"{folder}/{n}" not in inner]
        for path in doomed:
            _, target, fs = _filesystem(spark, f"{root}/{path}")
            fs.delete(target, True)
    return gone
