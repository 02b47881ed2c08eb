"""Event contract and the record envelope around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Field names and types of the event contract.
EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("patient_id", T.StringType()),
    T.StructField("lab_id", T.StringType()),
    T.StructField("event_time", T.TimestampType()),
    T.StructField("ingestion_time", T.TimestampType()),
    T.StructField("source", T.StringType()),
    T.StructField("schema_version", T.IntegerType()),
    T.StructField("patient_type", T.StringType()),
    T.StructField("priority", T.StringType()),
    T.StructField("appointment_id", T.StringType()),
    T.StructField("staff_id", T.StringType()),
])

RECORD_SCHEMA = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
])


def topic_options(servers: str, topic: str) -> dict[str, str]:
    """Options of a topic subscription that starts at the oldest record and survives lost ones (fixed values)."""
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
        "failOnDataLoss": "false",
    }


def read_record_stream(spark: SparkSession, fmt: str = "kafka", path: str | None = None,
                       **options: str) -> DataFrame:
    """Raw record stream. Any streaming format works; file formats get the record schema."""
    reader = spark.readStream.format(fmt).options(**options)
    if fmt == "kafka":
        return reader.load()
    return reader.schema(RECORD_SCHEMA).load(path)


def bronze_records(records: DataFrame) -> DataFrame:
    """Envelope columns as text plus the time of ingestion (constant per micro-batch)."""
    return records.select(
        "topic",
        "partition",
        "offset",
        F.col("timestamp").alias("kafka_timestamp"),
        F.col("key").cast("string").alias("event_key"),
        F.col("value").cast("string").alias("event_json"),
        F.current_timestamp().alias("bronze_ingestion_timestamp"),
    )


def publishable(events: DataFrame) -> DataFrame:
    """Key/value rows for a topic sink: one JSON document per event with every field, keyed by event_id."""
    whole = F.struct(*[F.col(c) for c in events.columns])
    return events.select(F.col("event_id").alias("key"), F.to_json(whole, {"ignoreNullFields": "false"}).alias("value"))


def publish(events: DataFrame, fmt: str = "kafka", path: str | None = None, **options: str) -> None:
    publishable(events).write.format(fmt).options(**options).mode("append").save(path)
