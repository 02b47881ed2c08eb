"""What-if replays of timeline points with more staff.

A visit names the blocks of windows in which it is in service, waits, or arrives within the lookahead. The visits
of a (lab, block) meet the block's timeline points, and the jobs of each window are served first come, first served
for every number of extra staff, in time that grows with the jobs. So the key space grows with the timeline, and a
group with what is going on in one block.
"""

from __future__ import annotations

from heapq import heapreplace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waitline.functions.clock import MINUTE_US, ceil_cell, cells, exact_cell, floor_cell, micros
from waitline.functions.spread import by_work
from waitline.params import Params

SERVING, WAITING, FUTURE = 0, 1, 2


def jobs_at(metrics: DataFrame, p: Params = Params()) -> DataFrame:
    """lab_id, cell (window start) and one job per visit that matters there, by (phase, place in line, id)."""
    step = p.step_us
    a, q, b, d = (micros(c) for c in ("arrival_time", "queue_entry_time", "service_start_time", "service_end_time"))
    minutes = lambda us: us / F.lit(float(MINUTE_US))

    def phase(number: int, low: Column, high: Column, place: Column, arrive, service, accrued) -> Column:
        """The cells of one phase of a visit, as jobs. Times are in minutes from the cell."""
        return F.transform(cells(low, high), lambda c: F.struct(c.alias("cell"), F.struct(
            F.lit(number).alias("phase"), place.alias("place"), F.col("patient_id").alias("id"), arrive(c * step).alias("arrive"),
            service(c * step).alias("service"), accrued(c * step).alias("accrued")).alias("job")))

    zero, none, length = lambda t: F.lit(0.0), lambda t: F.lit(None).cast("double"), lambda t: F.col("service_minutes")
    everything = F.concat(
        phase(SERVING, ceil_cell(b, step), ceil_cell(d, step) - 1, b, zero, lambda t: minutes(d - t), none),
        phase(WAITING, ceil_cell(q, step), ceil_cell(b, step) - 1, q, zero, length, lambda t: minutes(t - q)),
        phase(FUTURE, floor_cell(a - p.lookahead_minutes * MINUTE_US, step) + 1, floor_cell(a, step), a,
              lambda t: minutes(a - t), length, zero))
    return metrics.select("lab_id", F.explode(everything).alias("x")).select("lab_id", "x.cell", "x.job")


def served(jobs: Column, stations: Column) -> Column:
    """Waits of the scored jobs of a sorted array, served in order by so many stations.

    The state is the sorted free times of the stations; the first job to come takes the earliest.
    """
    start = F.struct(F.transform(F.sequence(F.lit(1), stations), lambda _: F.lit(0.0)).alias("free"),
                     F.array().cast("array<double>").alias("waits"))

    def step(state, job):
        begin = F.greatest(F.element_at(state["free"], 1), job["arrive"])
        rest = F.slice(state["free"], 2, F.size(state["free"]))
        waits = F.when(job["accrued"].isNull(), state["waits"]).otherwise(
            F.array_append(state["waits"], begin - job["arrive"] + job["accrued"]))
        return F.struct(F.array_sort(F.array_append(rest, begin + job["service"])).alias("free"), waits.alias("waits"))

    return F.aggregate(jobs, start, step, lambda state: F.array_sort(state["waits"]))


def scores(waits: Column, p: Params) -> Column:
    """Mean, floor-index P95, maximum and share within the target of sorted waits; 0, 0, 0, 100 without any."""
    n = F.size(waits)
    total = F.aggregate(waits, F.lit(0.0), lambda x, y: x + y)
    rank = F.floor(F.lit(0.95) * (n - 1)).cast("int") + 1
    within = F.size(F.filter(waits, lambda w: w <= p.queue_sla_minutes))
    some = n > 0
    return F.struct(F.when(some, total / n).otherwise(0.0).alias("avg"), F.when(some, F.get(waits, rank - 1)).otherwise(0.0).alias("p95"),
                    F.when(some, F.get(waits, n - 1)).otherwise(0.0).alias("max"), F.when(some, within / n * 100).otherwise(100.0).alias("sla"))


COUNTS, SCORES = ("initial_waiting", "initial_in_service", "future_arrivals", "already_breached"), ("avg", "p95", "max", "sla")
NEVER = -(1 << 62)
BLOCK = 12  # windows of a block: few enough to hold its visits, enough that most visits lie in one or two


def staffing_sweep(metrics: DataFrame, timeline: DataFrame, p: Params = Params(), at: str = "window_start") -> DataFrame:
    """Replay the actual next half hour of each point with 0..max extra staff.

    Arrays are indexed by extra staff. One row per timeline point; points lie on window starts. A visit goes to the blocks
    of windows it matters to, not to each window, and a block's windows are replayed where its visits are.
    """
    step, ahead = p.step_us, p.lookahead_minutes * MINUTE_US
    block = lambda cell: F.floor(cell / F.lit(BLOCK)).cast("long")
    points = timeline.select("lab_id", F.col(at).alias("window_start"), exact_cell(micros(at), step).alias("cell"))
    points = points.withColumn("block", block(F.col("cell")))
    a, q, b, d = (micros(c) for c in ("arrival_time", "queue_entry_time", "service_start_time", "service_end_time"))
    visits = metrics.select("lab_id", "patient_id", "service_minutes", a.alias("a"), q.alias("q"), b.alias("b"), d.alias("d"))
    spans = ((floor_cell(F.col("a") - ahead, step) + 1, floor_cell(F.col("a"), step)),
             (ceil_cell(F.col("q"), step), ceil_cell(F.col("b"), step) - 1), (ceil_cell(F.col("b"), step), ceil_cell(F.col("d"), step) - 1))
    touched = F.array_distinct(F.concat(*[F.when(lo <= hi, F.sequence(block(lo), block(hi))).otherwise(
        F.array().cast("array<bigint>")) for lo, hi in spans]))
    visits = visits.withColumn("block", F.explode(touched))

    def replay(windows: pa.Table, here: pa.Table) -> pa.Table:
        return replay_block(windows, here, p)

    keys = ("lab_id", "block")
    schema = points.select("lab_id", "window_start").schema
    for name, kind in (*zip(COUNTS, [T.IntegerType()] * 4), *zip(SCORES, [T.ArrayType(T.DoubleType())] * 4)):
        schema = schema.add(name, kind)
    pairs = by_work(points, *keys).groupBy(*keys).cogroup(by_work(visits, *keys).groupBy(*keys))
    rows = pairs.applyInArrow(replay, schema)
    if p.on_overflow == "error":
        fits = F.when(F.col("initial_in_service") > p.staff_count,
                      F.raise_error(F.lit("a window has more customers in service than stations")).cast("array<double>"))
        rows = rows.where(F.coalesce(F.size(fits), F.lit(0)) <= 0)
    return rows


def replay_block(windows: pa.Table, visits: pa.Table, p: Params) -> pa.Table:
    """Scores of each window of one block from the visits that matter there."""
    if not windows.num_rows:
        visits = visits.slice(0, 0)
    # First come, first served: one order for each phase, by place in line, then id.
    orders = {name: pc.sort_indices(visits, [(name, "ascending"), ("patient_id", "ascending"), *more], null_placement="at_start").to_numpy()
              for name, more in (("b", [("d", "ascending")]), ("q", [("service_minutes", "ascending")]), ("a", [("service_minutes", "ascending")]))}
    columns = {c: visits.column(c).to_numpy() for c in ("a", "q", "b", "d", "service_minutes")}
    serving, waiting, future = ({c: v[orders[by]] for c, v in columns.items()} for by in ("b", "q", "a"))
    minute, rows = float(MINUTE_US), []
    for cell in windows.column("cell").to_pylist():
        t = NEVER if cell is None else cell * p.step_us
        s = (serving["b"] <= t) & (t < serving["d"])
        w = (waiting["q"] <= t) & (t < waiting["b"])
        f = (future["a"] >= t) & (future["a"] - p.lookahead_minutes * MINUTE_US < t)
        busy, accrued = (serving["d"][s] - t) / minute, (t - waiting["q"][w]) / minute
        n, ahead = len(accrued), (future["a"][f] - t) / minute
        arrive, so_far = np.concatenate((np.zeros(n), ahead)), np.concatenate((accrued, np.zeros(len(ahead))))
        service = np.concatenate((waiting["service_minutes"][w], future["service_minutes"][f]))
        levels = replayed(busy, arrive, service, so_far, p)
        rows.append((n, len(busy), len(ahead), int((accrued > p.queue_sla_minutes).sum()), *map(list, zip(*levels))))
    kinds = [pa.int32()] * len(COUNTS) + [pa.list_(pa.float64())] * len(SCORES)
    out = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    return pa.Table.from_arrays([windows.column("lab_id"), windows.column("window_start"), *out],
                                ["lab_id", "window_start", *COUNTS, *SCORES])


def replayed(busy: np.ndarray, arrive: np.ndarray, service: np.ndarray, so_far: np.ndarray, p: Params) -> list[tuple]:
    """Mean, floor-index P95, maximum and share within the target for 0..max extra staff.

    A level is replayed only if more staff can still change its waits: with a station for every job, each wait is what
    the customer has waited so far, and once a level's waits are these, all further levels have them too.
    """
    extra = p.max_additional_staff + 1
    if not len(so_far):
        return [(0.0, 0.0, 0.0, 100.0)] * extra
    least = np.sort(so_far)
    jobs, ongoing, levels = list(zip(arrive.tolist(), service.tolist())), busy.tolist(), []
    for stations in range(p.staff_count, p.staff_count + extra):
        if len(busy) + len(jobs) <= stations or (levels and np.array_equal(waits, least)):
            waits = least
        else:
            free, begun = [0.0] * stations, []  # a heap of the stations' free times
            for length in ongoing:
                heapreplace(free, free[0] + length)
            for at, length in jobs:
                begin = free[0]
                if begin < at:
                    begin = at
                begun.append(begin)
                heapreplace(free, begin + length)
            waits = np.sort(np.array(begun) - arrive + so_far)
        n = len(waits)
        levels.append((float(np.add.accumulate(waits)[-1]) / n, float(waits[int(0.95 * (n - 1))]), float(waits[-1]),
                       int(np.searchsorted(waits, p.queue_sla_minutes, side="right")) / n * 100))
    return levels


def named(value: Column, then) -> Column:
    """An expression of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def scores_of(jobs: Column, stations: Column, p: Params) -> Column:
    """Scores of one number of stations; the waits are computed once and then named."""
    return named(served(jobs, stations), lambda waits: scores(waits, p))


def window_load(metrics: DataFrame, timeline: DataFrame, p: Params = Params(), at: str = "window_start") -> DataFrame:
    """Waiting, already breached and arriving customers of each point: counts alone, no replay."""
    points = timeline.select("lab_id", F.col(at).alias("window_start"), exact_cell(micros(at), p.step_us).alias("cell"))
    job = jobs_at(metrics, p)
    is_ = lambda number: F.col("job.phase") == number
    counts = job.groupBy("lab_id", "cell").agg(
        F.count_if(is_(WAITING)).cast("int").alias("initial_waiting"), F.count_if(is_(FUTURE)).cast("int").alias("future_arrivals"),
        F.count_if(is_(WAITING) & (F.col("job.accrued") > p.queue_sla_minutes)).cast("int").alias("already_breached"))
    names = ("initial_waiting", "future_arrivals", "already_breached")
    return points.join(counts, ["lab_id", "cell"], "left").select(
        "lab_id", "window_start", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
