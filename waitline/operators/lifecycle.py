"""Lifecycle rows per (patient, lab) and the durations of finished ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waitline.functions.clock import exact_minutes_between, minutes_between
from waitline.labels import LIFECYCLE_EVENTS
from waitline.params import Params

KEYS = ("patient_id", "lab_id")
ATTRIBUTES = ("patient_type", "priority", "staff_id")
STATE_COLUMNS = (*LIFECYCLE_EVENTS, *ATTRIBUTES)
FINISHED = ("arrival_time", "queue_entry_time", "service_start_time", "service_end_time", "departure_time")


def lifecycle_state(events: DataFrame, *extra_keys: str) -> DataFrame:
    """Pivot events to one row per (patient, lab): latest time per event type."""
    times = [F.max(F.when(F.col("event_type") == kind, F.col("event_time"))).alias(column)
             for column, kind in LIFECYCLE_EVENTS.items()]
    return events.groupBy(*KEYS, *extra_keys).agg(*times, *[F.max(a).alias(a) for a in ATTRIBUTES])


def merge_into(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per key of either side: for every column the new value, or the old one where that is missing."""
    was = old.select(*KEYS, *[F.col(c).alias(f"_{c}") for c in STATE_COLUMNS])
    return new.join(was, [*KEYS], "full").select(*KEYS, *[F.coalesce(c, f"_{c}").alias(c) for c in STATE_COLUMNS])


def merge_states(states: DataFrame, version: str = "batch_id") -> DataFrame:
    """Fold per-batch states: for every column the newest batch holding a value wins."""
    newest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(version))).alias(c)
              for c in STATE_COLUMNS]
    return states.groupBy(*KEYS).agg(*newest)


def finished(state: DataFrame) -> DataFrame:
    """Lifecycles with every needed time; registration is not required."""
    condition = F.lit(True)
    for column in FINISHED:
        condition = condition & F.col(column).isNotNull()
    return state.filter(condition)


def patient_metrics(state: DataFrame, p: Params = Params()) -> DataFrame:
    """Durations in minutes and service-level flags of finished lifecycles."""
    return (finished(state)
            .withColumn("registration_minutes", minutes_between("arrival_time", "registration_completed_time"))
            .withColumn("queue_wait_minutes", minutes_between("queue_entry_time", "service_start_time"))
            .withColumn("service_minutes", minutes_between("service_start_time", "service_end_time"))
            .withColumn("total_journey_minutes", minutes_between("arrival_time", "departure_time"))
            .withColumn("sla_breached", F.col("queue_wait_minutes") > p.queue_sla_minutes)
            .withColumn("waited", F.col("queue_wait_minutes") > 0)
            .select("patient_id", "lab_id", "patient_type", "priority", "staff_id",
                    *LIFECYCLE_EVENTS,
                    "registration_minutes", "queue_wait_minutes", "service_minutes",
                    "total_journey_minutes", "waited", "sla_breached"))


def recorded_journeys(events: DataFrame, order: str) -> DataFrame:
    """Offline variant: per patient, the last recorded event of each type counts and all six
    types are needed; durations keep fractions of a second."""
    def last(kind: str, column: str):
        return F.max_by(F.col(column), F.when(F.col("event_type") == kind, F.col(order)))

    kinds = {column.replace("registration_completed_time", "registration_time"): kind
             for column, kind in LIFECYCLE_EVENTS.items()}
    rows = events.groupBy("patient_id").agg(
        last("PATIENT_ARRIVAL", "lab_id").alias("lab_id"),
        *[last(kind, "event_time").alias(column) for column, kind in kinds.items()])
    whole = F.lit(True)
    for column in kinds:
        whole = whole & F.col(column).isNotNull()
    return (rows.filter(whole)
            .withColumn("registration_duration_minutes", exact_minutes_between("arrival_time", "registration_time"))
            .withColumn("queue_wait_minutes", exact_minutes_between("queue_entry_time", "service_start_time"))
            .withColumn("service_duration_minutes", exact_minutes_between("service_start_time", "service_end_time"))
            .withColumn("total_journey_minutes", exact_minutes_between("arrival_time", "departure_time")))


def wait_pairs(events: DataFrame, order: str) -> DataFrame:
    """Wait between the last queue entry and the last service start of each patient."""
    def last(kind: str):
        return F.max_by(F.col("event_time"), F.when(F.col("event_type") == kind, F.col(order)))

    pairs = (events.filter(F.col("event_type").isin("QUEUE_ENTERED", "SERVICE_STARTED"))
             .groupBy("patient_id")
             .agg(last("QUEUE_ENTERED").alias("queued"), last("SERVICE_STARTED").alias("started")))
    return (pairs.filter(F.col("queued").isNotNull() & F.col("started").isNotNull())
            .withColumn("wait_minutes", exact_minutes_between("queued", "started")))


def wait_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("patients"),
                     F.avg("wait_minutes").alias("average_wait_minutes"),
                     F.max("wait_minutes").alias("maximum_wait_minutes"),
                     F.sum(F.when(F.col("wait_minutes") > 0, 1).otherwise(0)).alias("patients_who_waited"))
