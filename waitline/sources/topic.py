"""A topic in files: records in segments per partition, in the order of their offsets, and a stream that follows them.

What a message broker does for a topic source, for tables: records are published in versions (`versions.py`), each of
which lists its segments with their first and last offsets. The stream's position is the next offset of each
partition, it starts at the earliest or latest record or at given offsets, and segments that are gone by the
time they are read either stop the query or are passed over.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from waitline.sources import versions
from waitline.sources.events import RECORD_SCHEMA
from waitline.sources.versions import LOG, _arrow_filesystem, _note

SEGMENT = 100_000


def publish_segments(records: DataFrame, root: str, version: int, length: int = SEGMENT) -> bool:
    """Publish records (key, value, topic, partition, offset, timestamp) as segments of `length` offsets at most.

    A version that is published is not published again. A partition's offsets only rise from version to version.
    """
    spark = records.sparkSession
    if versions.committed(spark, root, version):
        return False
    folder = versions.attempt(version)
    number = F.floor(F.col("offset") / length).alias("segment")
    cut = records.select(*[F.col(f.name).cast(f.dataType) for f in RECORD_SCHEMA.fields], F.col("partition").alias("of"), number)
    cut.repartition("of", "segment").sortWithinPartitions("of", "segment", "offset").write.partitionBy("of", "segment").parquet(f"{root}/{folder}")
    stored = spark.read.schema("of int, segment long, offset long").parquet(f"{root}/{folder}")
    ends = stored.groupBy("of", "segment").agg(F.min("offset").alias("first"), F.max("offset").alias("last"))
    segments = [{"partition": r["of"], "first": r["first"], "last": r["last"], "folder": f"{folder}/of={r['of']}/segment={r['segment']}"}
                for r in ends.orderBy("of", "first").collect()]  # one row per segment
    return versions.commit(spark, root, version, {"segments": segments})


class _Span(InputPartition):
    """Offsets from `low` on and before `high` of one file."""

    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


class _TopicReader(DataSourceStreamReader):
    def __init__(self, root: str, start: str, strict: bool):
        self.root, self.start, self.strict = root, start, strict
        self.known: dict[int, list[dict]] = {}

    def _segments(self) -> list[dict]:
        """Segments of all versions; a version's note is read once."""
        from pyarrow import fs

        files, base = _arrow_filesystem(self.root)
        for f in files.get_file_info(fs.FileSelector(f"{base}/{LOG}", allow_not_found=True)):
            name = f.base_name
            if name.endswith(".json") and name[:-5].isdigit() and int(name[:-5]) not in self.known:
                with files.open_input_stream(f"{base}/{_note(int(name[:-5]))}") as note:
                    self.known[int(name[:-5])] = json.loads(note.read())["segments"]
        return [s for v in sorted(self.known) for s in self.known[v]]

    def _ends(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for s in self._segments():
            out[str(s["partition"])] = max(out.get(str(s["partition"]), 0), s["last"] + 1)
        return out

    def initialOffset(self) -> dict:
        if self.start == "earliest":
            return {"next": {}}
        return {"next": self._ends() if self.start == "latest" else json.loads(self.start)}

    def latestOffset(self) -> dict:
        return {"next": self._ends()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        from pyarrow import fs

        files, base = _arrow_filesystem(self.root)
        out: list[InputPartition] = []
        for s in self._segments():
            key = str(s["partition"])
            low, high = max(start["next"].get(key, 0), s["first"]), min(end["next"].get(key, 0), s["last"] + 1)
            if low >= high:
                continue
            found = files.get_file_info(fs.FileSelector(f"{base}/{s['folder']}", allow_not_found=True))
            paths = sorted(f.path for f in found if f.base_name.endswith(".parquet"))
            if not paths:
                message = f"offsets {low} to {high - 1} of partition {key} are gone"
                if self.strict:
                    raise ValueError(f"{message}; failOnDataLoss=false passes over them")
                warnings.warn(message, stacklevel=1)
            out += [_Span(p, low, high) for p in paths]
        return out

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(RECORD_SCHEMA)
        files, _ = _arrow_filesystem(self.root)
        with files.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f, coerce_int96_timestamp_unit="us").iter_batches(columns=wanted.names):
                at = batch["offset"]
                batch = batch.filter(pc.and_(pc.greater_equal(at, partition.low), pc.less(at, partition.high)))
                columns = [batch[n].cast(pa.timestamp("us")).cast(t) if pa.types.is_timestamp(t) else batch[n].cast(t)
                           for n, t in zip(wanted.names, wanted.types)]
                yield pa.RecordBatch.from_arrays(columns, schema=wanted)


class SegmentedTopic(DataSource):
    """Options: root, startingOffsets (earliest, latest, or JSON of partition to offset), failOnDataLoss."""

    @classmethod
    def name(cls) -> str:
        return "segmented_topic"

    def schema(self) -> T.StructType:
        return RECORD_SCHEMA

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        strict = self.options.get("failOnDataLoss", "true").lower() != "false"
        return _TopicReader(self.options["root"], self.options.get("startingOffsets", "earliest"), strict)


def read_segments(spark: SparkSession, root: str, starting: str = "earliest", fail_on_data_loss: bool = False) -> DataFrame:
    """The topic as a stream of records."""
    versions.register(spark, SegmentedTopic)
    return (spark.readStream.format("segmented_topic").option("root", root).option("startingOffsets", starting)
            .option("failOnDataLoss", str(fail_on_data_loss).lower()).load())
