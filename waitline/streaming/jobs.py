"""Streaming jobs: bronze, silver and quarantine, batch counts, window counts, lifecycle upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from waitline.functions.scalars import event_lag_seconds
from waitline.labels import LIFECYCLE_EVENTS
from waitline.operators import ingest, lifecycle, windows
from waitline.params import Params
from waitline.sources import versions
from waitline.sources.events import EVENT_SCHEMA, bronze_records
from waitline.sources.session import DROP_SHUFFLES, settings, ship_package
from waitline.streaming.state import use_rocksdb

ALLOW_MULTIPLE, NO_DATA = "spark.sql.streaming.statefulOperator.allowMultiple", "spark.sql.streaming.noDataMicroBatches.enabled"

BRONZE_SCHEMA = T.StructType([
    T.StructField("topic", T.StringType()), T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()), T.StructField("kafka_timestamp", T.TimestampType()),
    T.StructField("event_key", T.StringType()), T.StructField("event_json", T.StringType()),
    T.StructField("bronze_ingestion_timestamp", T.TimestampType())])

SILVER_SCHEMA = T.StructType([
    *EVENT_SCHEMA.fields,
    *[BRONZE_SCHEMA[c] for c in ("kafka_timestamp", "bronze_ingestion_timestamp", "event_key", "topic",
                                 "partition", "offset")],
    T.StructField("event_lag_seconds", T.LongType()), T.StructField("is_late", T.BooleanType())])

QUARANTINE_SCHEMA = T.StructType([
    *BRONZE_SCHEMA.fields, T.StructField("quarantine_reason", T.StringType()), T.StructField("quarantine_timestamp", T.TimestampType())])


def table_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None,
                 consume: bool = False) -> DataFrame:
    """Follow a table another query appends to; the source's log makes each file count once.

    `consume`: nobody else reads the table, and the files of finished micro-batches are deleted."""
    reader = spark.readStream.schema(schema)
    if consume:
        reader = reader.option("cleanSource", "delete")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).select(*schema.names)


def append(df: DataFrame, path: str, checkpoint: str, drain: bool = False) -> StreamingQuery:
    """Append to a Parquet table with recovery from the checkpoint; `drain` stops when input ends."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if drain:
        writer = writer.trigger(availableNow=True)
    with settings(df.sparkSession, DROP_SHUFFLES):
        return writer.start(path)


def bronze_job(records: DataFrame, root: str, drain: bool = False) -> StreamingQuery:
    return append(bronze_records(records), f"{root}/bronze", f"{root}/checkpoints/bronze", drain)


def first_reads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the records of each id in one partition of a micro-batch, the one read first."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    held = pa.Table.from_batches(parts)
    ids, keep = held.select(["_id", "_record"]).to_pandas(), np.ones(held.num_rows, dtype=bool)
    copies = np.flatnonzero(ids.duplicated(keep=False).to_numpy())
    if len(copies):  # only these are put in order, and rows stay where they are
        places = held.select(["kafka_timestamp", "partition", "offset"]).take(pa.array(copies))
        copies = copies[pc.sort_indices(places, [(c, "ascending") for c in places.column_names]).to_numpy()]
        keep[copies[ids.iloc[copies].duplicated().to_numpy()]] = False
    start = 0
    for part in parts:
        yield part.filter(pa.array(keep[start:start + part.num_rows]))
        start += part.num_rows


def silver_stream(bronze: DataFrame, p: Params = Params()) -> DataFrame:
    """Parsed records: every rejected one, and of each event id the accepted record read first.

    The ids stored so far are the query's state, so a micro-batch costs what it holds and no stored table is
    read. Events behind the watermark are dropped. With `bounded_dedup` an id is forgotten once the watermark
    has passed it. A rejected record is told by its place in the topic and meets no other. Only rejected records
    keep their text, and only accepted ones their event, so that nothing unused is shuffled and held.
    """
    use_rocksdb(bronze.sparkSession)
    ship_package(bronze.sparkSession)
    ok = F.col("quarantine_reason").isNull()
    place = F.concat_ws("/", F.col("topic"), F.col("partition").cast("string"), F.coalesce(F.col("offset").cast("string"), F.uuid()))
    parsed = ingest.parse(bronze).withColumn("_id", F.when(ok, F.col("event.event_id"))).withColumn("_record", F.when(~ok, place))
    late = ok & (event_lag_seconds("bronze_ingestion_timestamp", "event.event_time") > p.late_after_seconds)
    number = lambda condition, name: F.sum(F.when(condition, 1).otherwise(0)).alias(name)
    parsed = parsed.observe("read", F.count(F.lit(1)).alias("records"), number(ok, "accepted"), number(~ok, "rejected"), number(late, "late"))
    parsed = parsed.withColumn("event", F.when(ok, F.col("event"))).withColumn("event_json", F.when(~ok, F.col("event_json")))
    one = parsed.repartition("_id", "_record").mapInArrow(first_reads, parsed.schema)
    marked = one.withColumn("_at", F.when(ok, F.col("event.event_time"))).withWatermark("_at", p.watermark)
    keys = ["_id", "_record"]
    fresh = marked.dropDuplicatesWithinWatermark(keys) if p.bounded_dedup else marked.dropDuplicates(keys)
    return fresh.observe("kept", number(ok, "stored")).drop("_id", "_record")  # `_at` stays: without it no row is behind


def silver_job(bronze: DataFrame, root: str, p: Params = Params(), drain: bool = False) -> StreamingQuery:
    """One query, one parse: accepted events, each id once, and rejected records.

    A batch commits both under its number. If either write fails the query stops with that error and the
    batch is run again from the checkpoint: what it had committed stays, what it had only written is never read.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            versions.append(ingest.rejected(batch), f"{root}/quarantine", batch_id)
            events = ingest.with_lag(ingest.accepted(batch), p)
            versions.append(events.select(*SILVER_SCHEMA.names), f"{root}/silver", batch_id)
        finally:
            batch.unpersist()

    writer = silver_stream(bronze, p).writeStream.foreachBatch(store).option("checkpointLocation", f"{root}/checkpoints/silver")
    if drain:
        writer = writer.trigger(availableNow=True)
    # With one stateful operator a batch goes by the watermark that all earlier batches give, not the one before.
    # Where no id is forgotten, a batch without records would do nothing.
    with settings(bronze.sparkSession, DROP_SHUFFLES | {name: "false" for name in (ALLOW_MULTIPLE, *(() if p.bounded_dedup else (NO_DATA,)))}):
        return writer.start()


def silver_table(spark: SparkSession, root: str) -> DataFrame:
    return versions.read(spark, f"{root}/silver", SILVER_SCHEMA)


def quarantine_table(spark: SparkSession, root: str) -> DataFrame:
    return versions.read(spark, f"{root}/quarantine", QUARANTINE_SCHEMA)


def follow_silver(spark: SparkSession, root: str) -> DataFrame:
    """Silver as a stream of committed batches."""
    return versions.follow(spark, f"{root}/silver", SILVER_SCHEMA)


# Counts of each micro-batch ------------------------------------------------------------------

COUNTS = "batch_id long, records long, accepted long, rejected long, late long, repeated long, dropped long, stored long"


def batch_counts(progress) -> dict[str, int] | None:
    """What a micro-batch of the silver job has read and stored; None for one without records.

    late: stored or not, more than the limit behind. repeated: ids read before, in this batch or an earlier one.
    dropped: behind the watermark.
    """
    read, kept = progress.observedMetrics.get("read"), progress.observedMetrics.get("kept")
    if not progress.numInputRows or read is None or kept is None:
        return None
    dropped = sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
    accepted, stored = read["accepted"] or 0, kept["stored"] or 0
    return {"batch_id": progress.batchId, "records": read["records"], "accepted": accepted, "rejected": read["rejected"] or 0,
            "late": read["late"] or 0, "repeated": accepted - stored - dropped, "dropped": dropped, "stored": stored}


class BatchCounts(StreamingQueryListener):
    """Puts the counts of every micro-batch of one query into a table, one small note each, once."""

    def __init__(self, spark: SparkSession, root: str, query_id: str | None = None):
        self.spark, self.root, self.query_id = spark, root, query_id

    def record(self, progress) -> None:
        counts = batch_counts(progress)
        if counts and (self.query_id is None or str(progress.id) == self.query_id):
            versions.commit(self.spark, self.root, counts["batch_id"], counts)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.record(event.progress)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def counts_table(spark: SparkSession, root: str) -> DataFrame:
    if versions.latest(spark, root) < 0:
        return spark.createDataFrame([], COUNTS)
    return spark.read.schema(COUNTS).json(f"{root}/{versions.LOG}")


def wait_for_any(spark: SparkSession, *queries: StreamingQuery) -> None:
    """Run jobs side by side until one ends; if it failed, stop the others and raise its error."""
    try:
        while all(q.isActive for q in queries):
            spark.streams.awaitAnyTermination(5)
            spark.streams.resetTerminated()
        for q in queries:
            if not q.isActive and q.exception() is not None:
                raise q.exception()
    finally:
        for q in queries:
            q.stop()


def window_count_job(silver: DataFrame, root: str, p: Params = Params(), drain: bool = False) -> StreamingQuery:
    return append(windows.event_counts(silver, p), f"{root}/window_counts", f"{root}/checkpoints/window_counts", drain)


# Lifecycles ---------------------------------------------------------------------------------

STATE_SCHEMA = T.StructType([
    *[T.StructField(c, T.StringType()) for c in lifecycle.KEYS], *[T.StructField(c, T.TimestampType()) for c in LIFECYCLE_EVENTS],
    *[T.StructField(c, T.StringType()) for c in lifecycle.ATTRIBUTES]])
BUCKETS, KEEP = 64, 2


def upsert(root: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """Micro-batch callback: merge the batch's lifecycle states into a table of hash buckets.

    Only buckets that the batch touches are read and written anew; a note names the folder of every bucket,
    so reading costs the same after any number of batches. A batch that is committed changes nothing when
    it comes again. The number of buckets is fixed by the first batch.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = versions.latest(spark, root)
        if batch_id <= last:
            return
        before = versions.note(spark, root, last) if last >= 0 else {"buckets": buckets, "folders": {}}
        number = before["buckets"]
        bucket = F.pmod(F.xxhash64(*lifecycle.KEYS), F.lit(number)).cast("int").alias("bucket")
        states = lifecycle.lifecycle_state(batch).select("*", bucket).persist()
        try:
            touched = sorted(r["bucket"] for r in states.select("bucket").distinct().collect())  # as many as buckets at most
            known = [f"{root}/{before['folders'][str(b)]}" for b in touched if str(b) in before["folders"]]
            merged = states
            if known:
                old = spark.read.schema(STATE_SCHEMA).parquet(*known)
                merged = lifecycle.merge_into(old, states.drop("bucket")).select("*", bucket)
            folder = versions.attempt(batch_id)
            if touched:
                merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/{folder}")
            folders = before["folders"] | {str(b): f"{folder}/bucket={b}" for b in touched}
            versions.commit(spark, root, batch_id, {"buckets": number, "folders": folders})
            versions.expire(spark, root, KEEP)
        finally:
            states.unpersist()

    return store


def lifecycle_job(silver: DataFrame, root: str, checkpoint: str, drain: bool = False) -> StreamingQuery:
    writer = silver.writeStream.foreachBatch(upsert(root)).option("checkpointLocation", checkpoint)
    if drain:
        writer = writer.trigger(availableNow=True)
    with settings(silver.sparkSession, DROP_SHUFFLES):
        return writer.start()


def lifecycles_of(spark: SparkSession, root: str, given: dict) -> DataFrame:
    """The lifecycles of one version. Take a lease while reading if the job may run on."""
    folders = [f"{root}/{f}" for f in sorted(given["folders"].values())]
    return spark.read.schema(STATE_SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], STATE_SCHEMA)


def read_lifecycles(spark: SparkSession, root: str) -> DataFrame:
    """Lifecycles as of the last committed batch."""
    last = versions.latest(spark, root)
    return lifecycles_of(spark, root, versions.note(spark, root, last) if last >= 0 else {"folders": {}})
