"""Point-in-time views on a regular time grid.

A range condition between visits and grid points is never joined: a visit names the cells
it covers (two rounded divisions), and cells are matched by equality.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waitline.functions.clock import MINUTE_US, ceil_cell, cells, floor_cell, micros, stamp
from waitline.functions.spread import running
from waitline.operators.windows import spine
from waitline.params import Params
from waitline.sources.tables import lookup, stage


def queue_snapshots(metrics: DataFrame, p: Params = Params(), keys: Sequence[str] = ("lab_id",),
                    align: str = "window") -> DataFrame:
    """Customers waiting and in service at every grid point, and utilisation.

    Each visit contributes one change at the first grid point where it starts to wait, is
    served and has left; running totals of the changes give the counts. Work is linear in
    visits plus grid points however long a visit lasts. The visits are read once: their
    changes per grid point are stored before the running totals read them twice.

    `align="window"` puts grid points on window starts; `align="minute"` anchors them at the
    minute of the first arrival, whatever the window size.
    """
    if align not in ("window", "minute"):
        raise ValueError("align must be 'window' or 'minute'")
    keys, step = list(keys), p.step_us
    dtype = metrics.schema["arrival_time"].dataType
    m = metrics.select(*keys, micros("arrival_time").alias("a"), micros("queue_entry_time").alias("q"),
                       micros("service_start_time").alias("b"), micros("service_end_time").alias("d"),
                       micros("departure_time").alias("e"))
    origin = F.lit(0).cast("long")
    if align == "minute":
        first = F.min("a")
        anchors = m.groupBy(*keys).agg((first - F.pmod(first, F.lit(MINUTE_US))).alias("anchor"))
        anchors = anchors.select(*keys, F.pmod(F.col("anchor"), F.lit(step)).alias("origin"))
        if keys:
            anchors = lookup(anchors)
            m, origin = m.join(anchors, keys), F.col("origin")
        else:
            origin = anchors.select("origin").scalar()

    def change(cell, waiting: int, serving: int, edge: bool = False):
        return F.struct(cell.alias("cell"), F.lit(waiting).alias("dw"), F.lit(serving).alias("ds"),
                        F.lit(edge).alias("edge"))

    a, q, b, d, e = (F.col(c) for c in "aqbde")
    up, down = (lambda us: ceil_cell(us, step, origin)), (lambda us: floor_cell(us, step, origin))
    nothing = F.array()
    changes = F.concat(
        F.array(change(down(a), 0, 0, True), change(down(e), 0, 0, True)),
        F.when(b > q, F.array(change(up(q), 1, 0), change(up(b), -1, 0))).otherwise(nothing),
        F.when(d > b, F.array(change(up(b), 0, 1), change(up(d), 0, -1))).otherwise(nothing))
    moved = stage(m.select(*keys, F.explode(changes).alias("c")).select(*keys, "c.*")
                  .groupBy(*keys, "cell").agg(F.sum("dw").alias("dw"), F.sum("ds").alias("ds"), F.max("edge").alias("edge")))
    limits = moved.filter("edge").groupBy(*keys).agg(F.min("cell").alias("lo"), F.max("cell").alias("hi"))
    points = spine(limits, keys, step).select(
        *keys, "cell", F.lit(0).cast("long").alias("dw"), F.lit(0).cast("long").alias("ds"), F.lit(True).alias("on_grid"))
    merged = moved.drop("edge").withColumn("on_grid", F.lit(False)).unionByName(points).groupBy(*keys, "cell").agg(
        F.sum("dw").alias("dw"), F.sum("ds").alias("ds"), F.max("on_grid").alias("on_grid"))
    counted = running(merged, keys, {"dw": "patients_waiting", "ds": "patients_in_service"}).filter("on_grid")
    if align == "minute" and keys:
        counted = counted.join(anchors, keys)
    return counted.select(*keys, stamp(F.col("cell") * step + origin, dtype).alias("timestamp"),
                          "patients_waiting", "patients_in_service",
                          (F.col("patients_in_service") / F.lit(p.staff_count) * 100).alias("utilization_percentage"))


def snapshot_at(metrics: DataFrame, instant, p: Params = Params()) -> DataFrame:
    """Queue length and customers in service per lab at one instant."""
    at = F.lit(instant).cast(metrics.schema["arrival_time"].dataType)
    waiting = (F.col("queue_entry_time") <= at) & (F.col("service_start_time") > at)
    serving = (F.col("service_start_time") <= at) & (F.col("service_end_time") > at)
    return metrics.groupBy("lab_id").agg(
        F.sum(F.when(waiting, 1).otherwise(0)).alias("patients_waiting"),
        F.sum(F.when(serving, 1).otherwise(0)).alias("patients_in_service")).withColumn("timestamp", at)


LOWEST_LEVEL = 20  # about a second


def covering(spans: DataFrame, lo: Column, hi: Column, instants: DataFrame, at: str, keys: Sequence[str] = ("lab_id",)) -> DataFrame:
    """Rows of spans next to each instant t with lo <= t < hi, at any microsecond.

    An index of levels: a span lies in the one or two bins of the level whose bins are as long as it is. An
    instant asks one bin of each level that occurs (at most 44, whatever the number of rows), and what it
    finds there is compared exactly. A bin holds spans of about its own length only, so few are in vain.
    """
    keys = list(keys)
    level = F.greatest(F.lit(LOWEST_LEVEL), F.length(F.bin(hi - lo)))  # binary digits, so a bin is longer than its spans
    bin_of = lambda us, size: F.floor(us / F.pow(F.lit(2.0), size)).cast("long")  # noqa: E731  exact: a power of two divides
    placed = spans.where(hi > lo).withColumn("_level", level)
    both = F.array_distinct(F.array(bin_of(lo, F.col("_level")), bin_of(hi - 1, F.col("_level"))))
    placed = placed.withColumn("_bin", F.explode(both))
    levels = [r["_level"] for r in placed.select("_level").distinct().collect()] or [LOWEST_LEVEL]
    asked = instants.withColumn("_at", micros(at)).withColumn("_level", F.explode(F.array(*map(F.lit, sorted(levels)))))
    asked = asked.withColumn("_bin", bin_of(F.col("_at"), F.col("_level")))
    # The edges follow again from what a span holds, so they are not shuffled with it.
    found = asked.join(placed, [*keys, "_level", "_bin"]).where((lo <= F.col("_at")) & (F.col("_at") < hi))
    return found.drop("_level", "_bin")


def queue_at(metrics: DataFrame, instants: DataFrame, at: str = "timestamp") -> DataFrame:
    """lab_id, instant, patients_waiting and patients_in_service of every instant (lab_id, at), on the grid or not."""
    m = metrics.select("lab_id", *[micros(c).alias(n) for c, n in (
        ("queue_entry_time", "q"), ("service_start_time", "b"), ("service_end_time", "d"))])
    spans = m.select("lab_id", F.explode(F.array(
        F.struct(F.lit(1).alias("waiting"), F.col("q").alias("lo"), F.col("b").alias("hi")),
        F.struct(F.lit(0).alias("waiting"), F.col("b").alias("lo"), F.col("d").alias("hi")))).alias("s")).select("lab_id", "s.*")
    asked = instants.select("lab_id", at).distinct()
    counts = covering(spans, F.col("lo"), F.col("hi"), asked, at).groupBy("lab_id", at).agg(
        F.sum("waiting").alias("w"), F.sum(1 - F.col("waiting")).alias("s"))
    return asked.join(counts, ["lab_id", at], "left").select(
        "lab_id", at, F.coalesce("w", F.lit(0)).alias("patients_waiting"), F.coalesce("s", F.lit(0)).alias("patients_in_service"))


def episode_at(metrics: DataFrame, instants: DataFrame, p: Params = Params(), at: str = "timestamp") -> DataFrame:
    """The visits that make up the episode at each instant, one row each.

    role WAITING (microseconds waited so far), SERVING (those of service left) or ARRIVING within the lookahead
    (those until then).
    """
    asked = instants.select("lab_id", at).distinct()
    columns = ["patient_id", "patient_type", "service_minutes"]
    rows = metrics.select("lab_id", *columns, *[micros(c).alias(n) for c, n in (
        ("arrival_time", "a"), ("queue_entry_time", "q"), ("service_start_time", "b"), ("service_end_time", "d"))])
    ahead = p.lookahead_minutes * MINUTE_US
    a, q, b, d, t = (F.col(c) for c in ("a", "q", "b", "d", "_at"))
    # A visit has one role at a time and is placed once, from where its arrival lies ahead to the end of its service.
    # One whose times are not in this order, or missing, may have several roles at a time: a part for each.
    times = lambda *known: F.struct(*[(c if n in known else F.lit(None).cast("long")).alias(n)
                                      for n, c in zip("aqbd", (a, q, b, d))])
    parts = F.when((a < q) & (q <= b) & (b <= d), F.array(times(*"aqbd"))).otherwise(F.array(times("a"), times("q", "b"), times("b", "d")))
    spans = rows.withColumn("s", F.explode(parts)).select("lab_id", *columns, "s.*")
    found = covering(spans, F.least(a - ahead + 1, q, b), F.greatest(a + 1, b, d), asked, at)
    role = (F.when((q <= t) & (t < b), "WAITING").when((b <= t) & (t < d), "SERVING").when((a - ahead < t) & (t <= a), "ARRIVING"))
    value = F.when(F.col("role") == "WAITING", t - q).when(F.col("role") == "SERVING", d - t).otherwise(a - t)
    return found.withColumn("role", role).where("role is not null").select("lab_id", at, "role", *columns, value.alias("microseconds"))


def _at_cells(metrics: DataFrame, lo, hi, p: Params) -> tuple[DataFrame, object]:
    step = p.step_us
    dtype = metrics.schema["arrival_time"].dataType
    rows = metrics.withColumn("cell", F.explode(cells(lo, hi)))
    us = F.col("cell") * step
    return rows.withColumn("timestamp", stamp(us, dtype)), us


def waiting_at(metrics: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per grid point and waiting visit: queue order, wait so far, service to come."""
    step = p.step_us
    rows, us = _at_cells(metrics, ceil_cell(micros("queue_entry_time"), step),
                         ceil_cell(micros("service_start_time"), step) - 1, p)
    return rows.select("lab_id", "timestamp", "patient_id", "patient_type", "queue_entry_time", "service_minutes",
                       ((us - micros("queue_entry_time")) / F.lit(float(MINUTE_US))).alias("accrued_wait_minutes"))


def serving_at(metrics: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per grid point and visit in service: remaining minutes."""
    step = p.step_us
    rows, us = _at_cells(metrics, ceil_cell(micros("service_start_time"), step),
                         ceil_cell(micros("service_end_time"), step) - 1, p)
    return rows.select("lab_id", "timestamp", "patient_id", "service_start_time",
                       ((micros("service_end_time") - us) / F.lit(float(MINUTE_US)))
                       .alias("remaining_service_minutes"))


def arriving_after(metrics: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per grid point and visit arriving within the lookahead: offset and service."""
    step = p.step_us
    a = micros("arrival_time")
    rows, us = _at_cells(metrics, floor_cell(a - p.lookahead_minutes * MINUTE_US, step) + 1,
                         floor_cell(a, step), p)
    return rows.select("lab_id", "timestamp", "patient_id", "patient_type", "service_minutes",
                       ((a - us) / F.lit(float(MINUTE_US))).alias("offset_minutes"))


def arrived_before(metrics: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per grid point and visit of the two history segments before it."""
    step, span = p.step_us, p.segment_minutes * MINUTE_US
    a = micros("arrival_time")
    rows, us = _at_cells(metrics, floor_cell(a, step) + 1, floor_cell(a + 2 * span, step), p)
    return rows.select("lab_id", "timestamp", "patient_id", "patient_type", "service_minutes", "arrival_time",
                       F.when(a < us - span, "OLDER").otherwise("RECENT").alias("segment"))
