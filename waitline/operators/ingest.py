"""Raw records to validated, lag-stamped, de-duplicated events; same code for batch and stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waitline.functions.scalars import event_lag_seconds, quarantine_reason
from waitline.params import Params
from waitline.sources.events import EVENT_SCHEMA

RECORD_COLUMNS = ("topic", "partition", "offset", "kafka_timestamp", "event_key", "event_json",
                  "bronze_ingestion_timestamp")


def _parse_once(records: DataFrame, parsed: Column) -> DataFrame:
    """Read the text once per row. Plain columns would be copied into the filter and into every
    field that is selected later, and each copy would parse again; a generator is not copied."""
    return records.withColumn("event", F.explode(F.array(parsed)))


def parse(records: DataFrame, strict_json: bool = False) -> DataFrame:
    """Add the typed `event` struct and the `quarantine_reason`.

    By default unreadable text parses to a struct of NULLs, so it is reported by its first
    missing field; `strict_json` reports it as malformed.
    """
    if not strict_json:
        parsed = _parse_once(records, F.from_json("event_json", EVENT_SCHEMA))
        return parsed.withColumn("quarantine_reason", quarantine_reason())
    schema = T.StructType([*EVENT_SCHEMA.fields, T.StructField("_corrupt", T.StringType())])
    parsed = _parse_once(records, F.from_json("event_json", schema, {"columnNameOfCorruptRecord": "_corrupt"}))
    # A record is corrupt as text when not even one field could be read.
    unread = F.col("event._corrupt").isNotNull() & F.col("event.event_id").isNull()
    return parsed.withColumn("quarantine_reason", quarantine_reason(corrupt=unread))


def rejected(parsed: DataFrame) -> DataFrame:
    return (parsed.filter(F.col("quarantine_reason").isNotNull())
            .select(*RECORD_COLUMNS, "quarantine_reason",
                    F.current_timestamp().alias("quarantine_timestamp")))


def accepted(parsed: DataFrame) -> DataFrame:
    return (parsed.filter(F.col("quarantine_reason").isNull())
            .select(*[F.col(f"event.{f.name}").alias(f.name) for f in EVENT_SCHEMA.fields],
                    "kafka_timestamp", "bronze_ingestion_timestamp", "event_key",
                    "topic", "partition", "offset"))


def with_lag(events: DataFrame, p: Params = Params()) -> DataFrame:
    """Seconds between event and ingestion, and whether that counts as late."""
    return (events
            .withColumn("event_lag_seconds", event_lag_seconds("bronze_ingestion_timestamp", "event_time"))
            .withColumn("is_late", F.col("event_lag_seconds") > p.late_after_seconds))


def first_of_each(events: DataFrame) -> DataFrame:
    """Batch de-duplication: the record read first wins, whatever the partitioning.

    An aggregate, not a window: copies of a hot event_id combine before the shuffle.
    """
    order = F.struct("kafka_timestamp", "partition", "offset")
    rest = [c for c in events.columns if c != "event_id"]
    return (events.groupBy("event_id")
            .agg(F.min_by(F.struct(*rest), order).alias("r"))
            .select("event_id", "r.*").select(*events.columns))


def first_of_each_stream(events: DataFrame, p: Params = Params()) -> DataFrame:
    """Streaming de-duplication inside one query: every id is kept as state, or with `bounded_dedup`
    only until the watermark passes it. Which copy in one micro-batch survives is not fixed here;
    the silver job fixes it."""
    marked = events.withWatermark("event_time", p.watermark)
    if p.bounded_dedup:
        return marked.dropDuplicatesWithinWatermark(["event_id"])
    return marked.dropDuplicates(["event_id"])


def silver(records: DataFrame, p: Params = Params(), strict_json: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """Validated events, each id once. `columns`: what the caller needs; only that and the order of reading are shuffled."""
    events = with_lag(accepted(parse(records, strict_json)), p)
    if records.isStreaming:
        return first_of_each_stream(events, p)
    if columns is None:
        return first_of_each(events)
    order = ("kafka_timestamp", "partition", "offset")
    return first_of_each(events.select(*dict.fromkeys(["event_id", *columns, *order]))).select(*columns)
