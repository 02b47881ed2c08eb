"""Windowed and whole-table aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waitline.functions.clock import DAY_US, MINUTE_US, cells, floor_cell, micros, stamp
from waitline.functions.scalars import queue_pressure, operational_status
from waitline.params import Params
from waitline.sources.tables import lookup


def event_counts(events: DataFrame, p: Params = Params()) -> DataFrame:
    """Tumbling counts per lab with mean lag and late events; batch or streaming."""
    if events.isStreaming:
        events = events.withWatermark("event_time", p.watermark)

    def of(kind: str, name: str) -> Column:
        return F.count(F.when(F.col("event_type") == kind, True)).alias(name)

    counted = events.groupBy(F.window("event_time", f"{p.window_minutes} minutes"), "lab_id").agg(
        of("PATIENT_ARRIVAL", "arrivals"),
        of("SERVICE_STARTED", "services_started"),
        of("SERVICE_COMPLETED", "services_completed"),
        of("PATIENT_DEPARTED", "departures"),
        F.avg("event_lag_seconds").alias("avg_event_lag_seconds"),
        F.sum(F.when(F.col("is_late"), 1).otherwise(0)).alias("late_event_count"),
    )
    return counted.select(F.col("window.start").alias("window_start"),
                          F.col("window.end").alias("window_end"), "lab_id", "arrivals",
                          "services_started", "services_completed", "departures",
                          "avg_event_lag_seconds", "late_event_count")


def operational_metrics(metrics: DataFrame, p: Params = Params()) -> DataFrame:
    """Arrival-cohort service levels per lab and window."""
    agg = metrics.groupBy(F.window("arrival_time", f"{p.window_minutes} minutes"), "lab_id").agg(
        F.count("*").alias("patients_arrived"),
        F.sum(F.when(F.col("waited"), 1).otherwise(0)).alias("patients_who_waited"),
        F.avg("queue_wait_minutes").alias("avg_queue_wait_minutes"),
        F.percentile_approx("queue_wait_minutes", 0.95, p.p95_accuracy).alias("p95_queue_wait_minutes"),
        F.max("queue_wait_minutes").alias("max_queue_wait_minutes"),
        F.avg("registration_minutes").alias("avg_registration_minutes"),
        F.avg("service_minutes").alias("avg_service_minutes"),
        F.avg("total_journey_minutes").alias("avg_total_journey_minutes"),
        F.sum(F.when(F.col("sla_breached"), 1).otherwise(0)).alias("sla_breaches"),
    )
    breach = F.col("sla_breaches") / F.col("patients_arrived") * 100
    return agg.select(F.col("window.start").alias("window_start"),
                      F.col("window.end").alias("window_end"), "lab_id", "patients_arrived",
                      "patients_who_waited", "avg_queue_wait_minutes", "p95_queue_wait_minutes",
                      "max_queue_wait_minutes", "avg_registration_minutes", "avg_service_minutes",
                      "avg_total_journey_minutes", "sla_breaches",
                      breach.alias("sla_breach_rate"), (100 - breach).alias("sla_compliance_rate"))


SKETCH = 4096  # rank error below a thousandth; exact for up to so many values


def wait_sketches(metrics: DataFrame, p: Params = Params()) -> DataFrame:
    """Mergeable sketch of the queue waits of each (lab, window); no visit is needed to roll it up."""
    counted = metrics.groupBy("lab_id", F.window("arrival_time", f"{p.window_minutes} minutes").alias("w")).agg(
        F.count("*").alias("patients"), F.kll_sketch_agg_double("queue_wait_minutes", SKETCH).alias("waits"))
    return counted.select("lab_id", F.col("w.start").alias("window_start"), "patients", "waits")


def rolled_up_percentile(sketches: DataFrame, length: str, share: float = 0.95) -> DataFrame:
    """lab_id, window_start, patients and the percentile of longer windows ("1 hour", "1 day"), from sketches of shorter ones."""
    merged = sketches.groupBy("lab_id", F.window("window_start", length).alias("w")).agg(
        F.sum("patients").alias("patients"), F.kll_merge_agg_double("waits", SKETCH).alias("waits"))
    return merged.select("lab_id", F.col("w.start").alias("window_start"), "patients",
                         F.kll_sketch_get_quantile_double("waits", F.lit(share)).alias("p95_queue_wait_minutes"))


def operational_state(operational: DataFrame, queue: DataFrame,
                      keys: Sequence[str] = ("lab_id",)) -> DataFrame:
    """Service levels joined to queue snapshots, with pressure and status labels.

    Pass no keys to join on time alone (a queue table without lab_id).
    """
    q = queue.select(*keys, F.col("timestamp").alias("window_start"), "patients_waiting",
                     "patients_in_service", "utilization_percentage")
    joined = operational.join(q, [*keys, "window_start"], "left").fillna(
        {"patients_waiting": 0, "patients_in_service": 0, "utilization_percentage": 0.0})
    return joined.select(*operational.columns, "patients_waiting", "patients_in_service",
                         "utilization_percentage",
                         queue_pressure(F.col("patients_waiting")).alias("queue_pressure"),
                         operational_status(F.col("patients_waiting"), F.col("sla_compliance_rate"),
                                            F.col("utilization_percentage")).alias("operational_status"))


def bounds(metrics: DataFrame, keys: Sequence[str] = ("lab_id",)) -> DataFrame:
    """First arrival, last arrival and last departure per key."""
    return metrics.groupBy(*keys).agg(F.min("arrival_time").alias("first_arrival"),
                                      F.max("arrival_time").alias("last_arrival"),
                                      F.max("departure_time").alias("last_departure"))


def spine(limits: DataFrame, keys: Sequence[str], step: int) -> DataFrame:
    """Every cell lo..hi of each key, grown day by day so no row holds a long array."""
    per_day = max(DAY_US // step, 1)
    blocks = limits.withColumn("_b", F.explode(F.sequence(
        F.floor(F.col("lo") / F.lit(per_day)), F.floor(F.col("hi") / F.lit(per_day)))))
    inside = cells(F.greatest(F.col("lo"), F.col("_b") * per_day),
                   F.least(F.col("hi"), F.col("_b") * per_day + (per_day - 1)))
    return blocks.select(*keys, F.explode(inside).alias("cell"))


def window_metrics(metrics: DataFrame, p: Params = Params(), window_minutes: int = 60,
                   start=None, end=None, servers: int | None = None) -> DataFrame:
    """Fixed windows from `start` to `end` per lab, empty ones included, the last one clipped.

    Arrivals and waits follow the arrival, completions and service time follow the end of
    service, utilisation follows the part of each service inside the window. The capacity of
    a clipped window is still that of a whole one. Without `start`/`end` each lab runs from
    the hour of its first arrival to its last departure.
    """
    if window_minutes <= 0:
        raise ValueError("fixed windows need a positive length")
    stations = p.staff_count if servers is None else servers
    if stations <= 0:
        raise ValueError("utilisation needs one station or more")
    step = window_minutes * MINUTE_US
    dtype = metrics.schema["arrival_time"].dataType
    limits = metrics.groupBy("lab_id").agg(
        F.min(F.date_trunc("hour", "arrival_time").cast(dtype)).alias("_s"),
        F.max("departure_time").alias("_e"))
    if start is not None:
        limits = limits.withColumn("_s", F.lit(start).cast(dtype))
    if end is not None:
        limits = limits.withColumn("_e", F.lit(end).cast(dtype))
    limits = lookup(limits.select("lab_id", micros("_s").alias("s"), micros("_e").alias("e")))

    m = metrics.join(limits, "lab_id").select(
        "lab_id", "s", "e", micros("arrival_time").alias("a"), micros("service_start_time").alias("b"),
        micros("service_end_time").alias("d"), "queue_wait_minutes", "service_minutes")
    inside = lambda us: (us >= F.col("s")) & (us < F.col("e"))
    zero = F.lit(0.0)

    def row(cell, arrivals=F.lit(0), wait=zero, breach=F.lit(0), served=F.lit(0), service=zero, busy=zero):
        return F.struct(cell.alias("cell"), arrivals.alias("arrivals"), wait.alias("wait"),
                        breach.alias("breach"), served.alias("served"), service.alias("service"),
                        busy.alias("busy"))

    wait = F.col("queue_wait_minutes")
    arrived = F.when(inside(F.col("a")), F.array(row(
        floor_cell(F.col("a"), step, F.col("s")), F.lit(1), wait,
        F.when(wait > p.queue_sla_minutes, 1).otherwise(0)))).otherwise(F.array())
    completed = F.when(inside(F.col("d")), F.array(row(
        floor_cell(F.col("d"), step, F.col("s")), served=F.lit(1), service=F.col("service_minutes")))
    ).otherwise(F.array())
    first = F.greatest(F.col("b"), F.col("s"))
    last = F.least(F.col("d"), F.col("e"))
    touched = cells(floor_cell(first, step, F.col("s")), floor_cell(last - 1, step, F.col("s")))
    overlaps = F.when(last > first, F.transform(touched, lambda c: row(c, busy=(
        F.least(F.col("d"), F.col("e"), F.col("s") + (c + 1) * step)
        - F.greatest(F.col("b"), F.col("s") + c * step)) / F.lit(float(MINUTE_US))))).otherwise(F.array())
    parts = m.select("lab_id", F.explode(F.concat(arrived, completed, overlaps)).alias("r")).select("lab_id", "r.*")

    ends = limits.filter(F.col("e") > F.col("s")).withColumn("lo", F.lit(0).cast("long")).withColumn(
        "hi", floor_cell(F.col("e") - 1, step, F.col("s")))
    empty = spine(ends, ["lab_id"], step).select("lab_id", row(F.col("cell")).alias("r")).select("lab_id", "r.*")
    total = parts.unionByName(empty).groupBy("lab_id", "cell").agg(
        F.sum("arrivals").alias("arrivals"), F.sum("wait").alias("wait"),
        F.max(F.when(F.col("arrivals") > 0, F.col("wait"))).alias("top"), F.sum("breach").alias("breach"),
        F.sum("served").alias("served"), F.sum("service").alias("service"), F.sum("busy").alias("busy"))

    def ratio(top, bottom):
        return F.when(bottom > 0, top / bottom).otherwise(0.0)

    at = F.col("s") + F.col("cell") * step
    return total.join(limits, "lab_id").select(
        "lab_id", stamp(at, dtype).alias("window_start"),
        stamp(F.least(at + step, F.col("e")), dtype).alias("window_end"),
        "arrivals", F.col("served").alias("patients_served"),
        ratio(F.col("wait"), F.col("arrivals")).alias("average_queue_wait_minutes"),
        F.coalesce("top", F.lit(0.0)).alias("maximum_queue_wait_minutes"),
        ratio(F.col("service"), F.col("served")).alias("average_service_time_minutes"),
        (F.col("busy") / F.lit(float(window_minutes * stations))).alias("utilization"),
        ratio(F.col("breach"), F.col("arrivals")).alias("sla_breach_rate"))


def lab_summary(metrics: DataFrame, operating_hours: float, stations: int) -> DataFrame:
    """Totals per lab, guarded against zero hours or stations."""
    capacity = F.lit(float(operating_hours) * 60 * stations)
    hours = F.lit(float(operating_hours))
    return (metrics.groupBy("lab_id")
            .agg(F.count("*").alias("total_patients"), F.sum("service_minutes").alias("total_service_minutes"))
            .select("lab_id", "total_patients", F.col("total_patients").alias("patients_served"),
                    "total_service_minutes",
                    F.when(capacity > 0, F.col("total_service_minutes") / capacity).otherwise(0.0).alias("utilization"),
                    F.when(hours > 0, F.col("total_patients") / hours).otherwise(0.0).alias("patients_per_hour")))


def sla_summary(metrics: DataFrame, p: Params = Params()) -> DataFrame:
    """Within/breaching counts and the breach fraction per lab."""
    within = F.sum(F.when(F.col("queue_wait_minutes") <= p.queue_sla_minutes, 1).otherwise(0))
    return (metrics.groupBy("lab_id").agg(F.count("*").alias("total_patients"), within.alias("patients_within_sla"))
            .withColumn("patients_breaching_sla", F.col("total_patients") - F.col("patients_within_sla"))
            .withColumn("sla_breach_rate", F.col("patients_breaching_sla") / F.col("total_patients")))


def journey_summary(metrics: DataFrame) -> DataFrame:
    """One row over all finished visits."""
    return metrics.agg(
        F.count("*").alias("patients"),
        F.avg("registration_minutes").alias("avg_registration"),
        F.avg("queue_wait_minutes").alias("avg_queue_wait"),
        F.max("queue_wait_minutes").alias("max_queue_wait"),
        F.avg("service_minutes").alias("avg_service"),
        F.avg("total_journey_minutes").alias("avg_total_journey"),
        F.sum(F.when(F.col("waited"), 1).otherwise(0)).alias("patients_who_waited"),
        F.sum(F.when(F.col("sla_breached"), 1).otherwise(0)).alias("sla_breaches"))


def rolled_up(operational: DataFrame) -> DataFrame:
    """Totals rebuilt from window means weighted by their counts."""
    n = F.col("patients_arrived")

    def mean(c: str, name: str) -> Column:
        return (F.sum(F.col(c) * n) / F.sum(n)).alias(name)

    return operational.agg(F.sum(n).alias("total_patients"),
                           mean("avg_queue_wait_minutes", "average_wait"),
                           F.max("max_queue_wait_minutes").alias("maximum_wait"),
                           mean("avg_service_minutes", "average_service"),
                           mean("avg_total_journey_minutes", "average_journey"),
                           F.sum("sla_breaches").alias("total_sla_breaches"))


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def shares_by(df: DataFrame, column: str) -> DataFrame:
    """Counts with their percentage of the total (a window over the few counted values)."""
    n = counts_by(df, column)
    return n.withColumn("percentage", F.col("n") / F.sum("n").over(Window.partitionBy()) * 100)


def arrivals_by_hour(df: DataFrame, column: str = "arrival_time") -> DataFrame:
    return df.groupBy(F.hour(column).alias("hour")).agg(F.count("*").alias("arrivals"))


def distinct_patients(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("events"), F.count_distinct("patient_id").alias("patients"))
