"""Visit view over the driver's `events` table: one event row stands for one visit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waitline.labels import LIFECYCLE_EVENTS


def visits(spark: SparkSession, folder: str) -> DataFrame:
    """Finished lifecycles derived from `events`, spread over two labs."""
    return visits_of(spread(spark.read.parquet(f"{folder}/events.parquet")))


ROWS_PER_TASK = 100_000  # a row becomes six or seven records with text of their own


def spread(df: DataFrame) -> DataFrame:
    """Use every core, and as many tasks as the rows need, on an input that comes as fewer splits.

    What a task sorts or parses is then bounded however large the table is; a table of enough splits is read as it lies.
    Rows go by their values, as dealing them in turn would first sort each split. Later shuffles get as many partitions
    at least (adaptive execution merges small ones), so that what comes out of them is bounded too.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.isStreaming:
        return df.repartition(cores)
    needed = -(-df.count() // ROWS_PER_TASK)
    if int(spark.conf.get("spark.sql.shuffle.partitions")) < needed:
        spark.conf.set("spark.sql.shuffle.partitions", str(needed))
    if df.rdd.getNumPartitions() < max(cores, needed):
        return df.repartition(max(cores, needed), *df.columns)
    return df


def visits_of(events: DataFrame) -> DataFrame:
    user, event = F.col("user_id"), F.col("event_id")
    base = events.select(
        F.concat(F.lit("P"), event.cast("string")).alias("patient_id"),
        F.when(user % 2 == 0, "LAB_A").otherwise("LAB_B").alias("lab_id"),
        F.when(user % 4 == 0, "OUTPATIENT").when(user % 4 == 1, "INPATIENT")
        .when(user % 4 == 2, "WALK_IN").otherwise("FOLLOW_UP").alias("patient_type"),
        F.when(event % 4 == 0, "NORMAL").when(event % 4 == 1, "URGENT")
        .when(event % 4 == 2, "PEDIATRIC").otherwise("ELDERLY").alias("priority"),
        F.concat(F.lit("STAFF_0"), (event % 4 + 1).cast("string")).alias("staff_id"),
        F.date_trunc("second", "ts").cast("timestamp_ntz").alias("arrival_time"),
        (F.floor("value").cast("int") % 25).alias("_wait"),
        (F.lit(3) + event % 7).cast("int").alias("_service"),
    )

    def after(start: str, minutes):
        return F.col(start) + F.make_dt_interval(F.lit(0), F.lit(0), minutes)

    return (base
            .withColumn("registration_completed_time", after("arrival_time", F.lit(2)))
            .withColumn("queue_entry_time", F.col("registration_completed_time"))
            .withColumn("service_start_time", after("queue_entry_time", F.col("_wait")))
            .withColumn("service_end_time", after("service_start_time", F.col("_service")))
            .withColumn("departure_time", F.col("service_end_time"))
            .drop("_wait", "_service"))


def visit_events(spark: SparkSession, folder: str) -> DataFrame:
    return events_of(visits(spark, folder))


def events_of(v: DataFrame) -> DataFrame:
    """Long form: six lifecycle events per visit; `seq` is the order they were recorded in.

    Every seventh visit reports its arrival twice, the second time two minutes later, so
    that rules for repeated events matter.
    """
    stages = [F.struct(F.lit(i).alias("seq"), F.lit(kind).alias("event_type"),
                       F.col(column).alias("event_time"))
              for i, (column, kind) in enumerate(LIFECYCLE_EVENTS.items())]
    again = F.struct(F.lit(len(stages)).alias("seq"), F.lit("PATIENT_ARRIVAL").alias("event_type"),
                     (F.col("arrival_time") + F.expr("INTERVAL 2 MINUTES")).alias("event_time"))
    repeat = F.expr("substring(patient_id, 2)").cast("long") % 7 == 0
    rows = v.withColumn("e", F.explode(F.when(repeat, F.array(*stages, again)).otherwise(F.array(*stages))))
    return rows.select(
        F.concat_ws("_", "patient_id", "e.event_type").alias("event_id"),
        F.col("e.event_type").alias("event_type"),
        "patient_id", "lab_id",
        F.col("e.event_time").alias("event_time"),
        F.lit("visits").alias("source"),
        "patient_type", "priority", "staff_id",
        F.col("e.seq").alias("seq"),
    )


def visit_records(spark: SparkSession, folder: str) -> DataFrame:
    return records_of(visit_events(spark, folder))


def records_of(e: DataFrame) -> DataFrame:
    """Bronze-shaped records of the long form, with faults mixed in by event number.

    Residue of the visit number modulo 11 on SERVICE_STARTED events: 1 has no text, 2 is not
    JSON, 3 lacks patient_id, 4 lacks lab_id, 5 has an unreadable event_time, 6 lacks event_type.
    Ingestion lags the event by (number modulo 13) minutes.
    """
    number = F.expr("substring(patient_id, 2)").cast("long")
    fault = F.when(F.col("event_type") == "SERVICE_STARTED", number % 11).otherwise(F.lit(0))
    at = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def keep(column, code):
        return F.when(fault != code, column)

    text = F.to_json(F.struct(
        F.col("event_id"),
        keep(F.col("event_type"), 6).alias("event_type"),
        keep(F.col("patient_id"), 3).alias("patient_id"),
        keep(F.col("lab_id"), 4).alias("lab_id"),
        F.when(fault == 5, F.lit("yesterday")).otherwise(at).alias("event_time"),
        at.alias("ingestion_time"), F.col("source"), F.lit(1).alias("schema_version"),
        F.col("patient_type"), F.col("priority"), F.col("staff_id"),
    ))
    late = F.make_dt_interval(F.lit(0), F.lit(0), (number % 13).cast("int"))
    arrived = (F.col("event_time") + late).cast("timestamp")
    return e.select(
        F.lit("visits").alias("topic"),
        (number % 4).cast("int").alias("partition"),
        (number * 8 + F.col("seq")).alias("offset"),
        arrived.alias("kafka_timestamp"),
        F.col("event_id").alias("event_key"),
        F.when(fault == 1, F.lit(None).cast("string")).when(fault == 2, F.lit("not json"))
        .otherwise(text).alias("event_json"),
        arrived.alias("bronze_ingestion_timestamp"),
    )
