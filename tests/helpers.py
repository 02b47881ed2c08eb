"""Plain-Python restatements used to check the Spark results."""

from __future__ import annotations

import heapq
import random
from datetime import datetime, timedelta

import pandas as pd

T0 = datetime(2024, 1, 1, 8, 0)


def at(minutes: float) -> datetime:
    return T0 + timedelta(minutes=minutes)


def visit(number: int, arrival: float, wait: float, service: float, lab: str = "LAB_A", registration: float = 2.0):
    queue = arrival + registration
    return {"patient_id": f"P{number:04d}", "lab_id": lab, "patient_type": ["WALK_IN", "INPATIENT"][number % 2],
            "priority": "NORMAL", "staff_id": None, "arrival_time": at(arrival),
            "registration_completed_time": at(queue), "queue_entry_time": at(queue),
            "service_start_time": at(queue + wait), "service_end_time": at(queue + wait + service),
            "departure_time": at(queue + wait + service)}


SCHEMA = ("patient_id string, lab_id string, patient_type string, priority string, staff_id string, "
          "arrival_time timestamp, registration_completed_time timestamp, queue_entry_time timestamp, "
          "service_start_time timestamp, service_end_time timestamp, departure_time timestamp")


def visit_frame(spark, rows):
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], SCHEMA)


def random_visits(n: int, seed: int, minutes: int, labs=("LAB_A", "LAB_B"), hot: float = 0.7):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lab = labs[0] if rng.random() < hot else rng.choice(labs[1:])
        out.append(visit(i, rng.randrange(0, minutes * 60) / 60, rng.choice([0, 0, 3, 7.5, 16, 40]),
                         rng.choice([3, 4.25, 6, 9]), lab))
    return out


def heap_waits(jobs, servers: int):
    """jobs: (arrive, service, accrued or None) in queue order -> waits of the scored ones."""
    free = [0.0] * servers
    heapq.heapify(free)
    waits = []
    for arrive, service, accrued in jobs:
        start = max(heapq.heappop(free), arrive)
        heapq.heappush(free, start + service)
        if accrued is not None:
            waits.append(accrued + start - arrive)
    return waits


def scorecard(waits, sla: float = 15.0):
    if not waits:
        return 0.0, 0.0, 0.0, 100.0
    ranked = sorted(waits)
    return (sum(waits) / len(waits), ranked[int(0.95 * (len(waits) - 1))], ranked[-1],
            sum(w <= sla for w in waits) / len(waits) * 100)


def minutes(a: datetime, b: datetime) -> float:
    return (b - a).total_seconds() / 60


def state_jobs(rows, lab, t):
    rows = [r for r in rows if r["lab_id"] == lab]
    serving = sorted((r["service_start_time"], r["patient_id"], r) for r in rows
                     if r["service_start_time"] <= t < r["service_end_time"])
    waiting = sorted((r["queue_entry_time"], r["patient_id"], r) for r in rows
                     if r["queue_entry_time"] <= t < r["service_start_time"])
    return ([(0.0, minutes(t, r["service_end_time"]), None) for *_, r in serving]
            + [(0.0, minutes(r["service_start_time"], r["service_end_time"]), minutes(r["queue_entry_time"], t))
               for *_, r in waiting])


def arrivals_between(rows, lab, start, stop):
    return [r for *_, r in sorted((r["arrival_time"], r["patient_id"], r) for r in rows
                                  if r["lab_id"] == lab and start <= r["arrival_time"] < stop)]


def rounded(rows, digits: int = 6):
    return sorted(tuple(round(v, digits) if isinstance(v, float) else v for v in row) for row in rows)


def frame(df) -> pd.DataFrame:
    return df.toPandas()


def fold_scores(spark, cases, stations):
    """(mean, P95, maximum, share) per case and number of stations, from the replay's own expressions."""
    from pyspark.sql import functions as F

    from waitline.operators import replay
    from waitline.params import Params

    schema = "n int, jobs array<struct<arrive: double, service: double, accrued: double>>"
    rows = [(i, [(float(a), float(s), None if w is None else float(w)) for a, s, w in jobs]) for i, jobs in enumerate(cases)]
    df = spark.createDataFrame(rows, schema).select("n", *[
        replay.scores_of(F.col("jobs"), F.lit(c), Params()).alias(f"c{c}") for c in stations]).orderBy("n")
    return [[tuple(r[f"c{c}"]) for c in stations] for r in df.collect()]
