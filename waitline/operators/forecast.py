"""Arrival counts around grid points, rate forecasts and their errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waitline.functions import clock
from waitline.functions.clock import MINUTE_US, floor_cell, micros, stamp
from waitline.functions.spread import running, with_block, with_neighbours
from waitline.labels import LOOKBACKS
from waitline.params import Params
from waitline.sources.tables import stage


def arrival_cells(metrics: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per lab and window with arrivals: their count, the first and the last. Stored, as counts,
    timeline points and edges of the data are all read from it."""
    return stage(metrics.groupBy("lab_id", floor_cell(micros("arrival_time"), p.step_us).alias("cell")).agg(
        F.count("*").alias("n"), F.min("arrival_time").alias("first"), F.max("arrival_time").alias("last")))


def cell_points(cells: DataFrame, p: Params = Params(), at: str = "window_start") -> DataFrame:
    """The windows of arrival cells as timeline points."""
    return cells.select("lab_id", stamp(F.col("cell") * p.step_us, cells.schema["first"].dataType).alias(at))


def arrivals_around(metrics: DataFrame, timeline: DataFrame, spans: dict[str, tuple[int, int]],
                    p: Params = Params(), at: str = "window_start") -> DataFrame:
    """Count arrivals in [t + from, t + to) minutes for each named span at each timeline point.

    Arrivals are counted per cell first; the spans are then bounded windows over the counts,
    evaluated in blocks of cells with the neighbouring cells copied in. One job for all spans.
    `metrics`: patient metrics, or the arrival cells made from them.
    """
    step = p.step_us
    ahead = max([to // p.window_minutes for _, to in spans.values()] + [0])
    back = max([-start // p.window_minutes for start, _ in spans.values()] + [0])
    counts = metrics if "cell" in metrics.columns else metrics.groupBy(
        "lab_id", floor_cell(micros("arrival_time"), step).alias("cell")).agg(F.count("*").alias("n"))
    counts = counts.select("lab_id", "cell", "n")
    points = timeline.select("lab_id", floor_cell(micros(at), step).alias("cell")).distinct()
    merged = (counts.withColumn("asked", F.lit(False))
              .unionByName(points.select("lab_id", "cell", F.lit(0).alias("n"), F.lit(True).alias("asked")))
              .groupBy("lab_id", "cell").agg(F.sum("n").alias("n"), F.max("asked").alias("asked")))
    order = Window.partitionBy("lab_id", "_block").orderBy("cell")
    spread = with_neighbours(merged, back, ahead)
    for name, (start, stop) in spans.items():
        frame = order.rangeBetween(start // p.window_minutes, stop // p.window_minutes - 1)
        spread = spread.withColumn(name, F.coalesce(F.sum("n").over(frame), F.lit(0)))
    dtype = timeline.schema[at].dataType
    return (spread.filter(F.col("_own") & F.col("asked"))
            .select("lab_id", stamp(F.col("cell") * step, dtype).alias(at), *spans))


def rolling_rate(n: Column, lookback: float) -> Column:
    return n / F.lit(float(lookback))


def weighted_rate(older: Column, recent: Column, p: Params = Params()) -> Column:
    seg = F.lit(float(p.segment_minutes))
    return ((older / seg * p.older_weight + recent / seg * p.recent_weight)
            / F.lit(p.older_weight + p.recent_weight))


def trend_rate(older: Column, recent: Column, p: Params = Params()) -> Column:
    seg = F.lit(float(p.segment_minutes))
    return F.greatest(F.lit(0.0), recent / seg + F.lit(p.trend_strength) * (recent / seg - older / seg))


def _arrival_edges(metrics: DataFrame) -> DataFrame:
    first, last = ("first", "last") if "cell" in metrics.columns else ("arrival_time", "arrival_time")
    return metrics.groupBy("lab_id").agg(F.min(first).alias("_first"), F.max(last).alias("_last"))


def eligible_points(points: DataFrame, metrics: DataFrame, lookback: int, horizon: int,
                    at: str = "window_start") -> DataFrame:
    """Keep points whose whole lookback and horizon lie between the first and last arrival."""
    us = micros(at)
    return (points.join(_arrival_edges(metrics), "lab_id")
            .filter((us - lookback * MINUTE_US >= micros("_first")) & (us + horizon * MINUTE_US <= micros("_last")))
            .drop("_first", "_last"))


def strategy_forecasts(metrics: DataFrame, timeline: DataFrame, p: Params = Params()) -> DataFrame:
    """Actual arrivals of the next horizon and what each strategy predicted, per eligible point."""
    seg, horizon = p.segment_minutes, p.lookahead_minutes
    around = arrivals_around(metrics, timeline, {
        "older": (-2 * seg, -seg), "recent": (-seg, 0), "actual": (0, horizon)}, p)
    rows = eligible_points(around, metrics, 2 * seg, horizon)
    return rows.select(
        "lab_id", "window_start", "older", "recent", "actual",
        (rolling_rate(F.col("older") + F.col("recent"), 2 * seg) * horizon).alias("rolling_rate"),
        (weighted_rate(F.col("older"), F.col("recent"), p) * horizon).alias("weighted_recent"),
        (trend_rate(F.col("older"), F.col("recent"), p) * horizon).alias("trend_adjusted"))


def forecast_errors(pairs: DataFrame, keys: Sequence[str], actual: str = "actual",
                    predicted: str = "predicted") -> DataFrame:
    """Count, MAE, bias, RMSE and MAPE (over positive actuals, NULL when there are none)."""
    a, e = F.col(actual), F.col(predicted) - F.col(actual)

    def mean(c: Column) -> Column:
        return F.coalesce(F.avg(c), F.lit(0.0))

    return pairs.groupBy(*keys).agg(
        F.count("*").alias("observations"), mean(F.abs(e)).alias("mae"), mean(e).alias("bias"),
        F.sqrt(mean(e * e)).alias("rmse"), (F.avg(F.when(a > 0, F.abs(e) / a)) * 100).alias("mape"))


def compare_strategies(metrics: DataFrame, timeline: DataFrame, p: Params = Params()) -> DataFrame:
    """Errors per strategy over the same points."""
    wide = strategy_forecasts(metrics, timeline, p)
    long = wide.select("actual", F.explode(F.array(*[
        F.struct(F.lit(name.upper()).alias("strategy"), F.col(name).alias("predicted"))
        for name in ("rolling_rate", "weighted_recent", "trend_adjusted")])).alias("s")).select("actual", "s.*")
    return forecast_errors(long, ["strategy"])


def compare_lookbacks(metrics: DataFrame, timeline: DataFrame, p: Params = Params(),
                      lookbacks: Sequence[int] = LOOKBACKS) -> DataFrame:
    """Errors of the rolling rate per lookback; each lookback uses the points it is eligible for."""
    horizon = p.lookahead_minutes
    spans = {f"b{m}": (-m, 0) for m in lookbacks}
    around = arrivals_around(metrics, timeline, {**spans, "actual": (0, horizon)}, p)
    rows = around.join(_arrival_edges(metrics), "lab_id").filter(
        micros("window_start") + horizon * MINUTE_US <= micros("_last"))
    long = rows.select("window_start", "_first", "actual", F.explode(F.array(*[
        F.struct(F.lit(m).alias("lookback_minutes"), F.col(f"b{m}").alias("n")) for m in lookbacks])).alias("s"))
    long = long.select("window_start", "_first", "actual", "s.*").filter(
        micros("window_start") - F.col("lookback_minutes").cast("long") * MINUTE_US >= micros("_first"))
    pairs = long.withColumn("predicted", F.col("n") / F.col("lookback_minutes") * horizon)
    return forecast_errors(pairs, ["lookback_minutes"])


def best_forecast(errors: DataFrame, name: str) -> DataFrame:
    """The row with the smallest (MAE, |bias|, RMSE) among those with observations."""
    return (errors.filter(F.col("observations") > 0)
            .agg(F.min_by(F.struct(*errors.columns), F.struct(
                F.col("mae"), F.abs("bias"), F.col("rmse"), F.col(name))).alias("r"))
            .filter(F.col("r").isNotNull()).select("r.*"))


def timeline_index(timeline: DataFrame, p: Params = Params(), at: str = "timestamp") -> DataFrame:
    """1-based position of each point on its lab's timeline. The points are stored, as block totals and rows both read them."""
    cell = timeline.withColumn("cell", floor_cell(micros(at), p.step_us)).withColumn("_one", F.lit(1).cast("long"))
    return running(stage(cell), ["lab_id"], {"_one": "timeline_index"}).drop("cell", "_one")


def demand_profile(metrics: DataFrame, timeline: DataFrame, p: Params = Params(),
                   weighted: bool = True, at: str = "timestamp") -> DataFrame:
    """Arrival rate per minute estimated at each point from the two history segments."""
    seg = p.segment_minutes
    around = arrivals_around(metrics, timeline, {"older_count": (-2 * seg, -seg), "recent_count": (-seg, 0)}, p, at)
    rate = (weighted_rate(F.col("older_count"), F.col("recent_count"), p) if weighted
            else rolling_rate(F.col("older_count") + F.col("recent_count"), 2 * seg))
    return around.withColumn("arrival_rate_per_minute", rate)


def record_intervals(metrics: DataFrame, p: Params = Params()) -> DataFrame:
    """How many visits of each (lab, type, service time) are in the older and the recent history segment, cell by cell.

    A sliding multiset: a visit enters the recent segment, moves to the older one and leaves, at three cells
    that follow from its arrival. Running totals of these changes hold from one cell of change to the next, so no
    point gathers a list of records. Rows: the kind, cells `lo` to `hi`, older_count and recent_count.
    """
    step, span = p.step_us, p.segment_minutes * MINUTE_US
    a, kind = micros("arrival_time"), ["lab_id", "patient_type", "service_minutes"]
    moves = F.array(*[F.struct((floor_cell(a + shift, step) + 1).alias("cell"), F.lit(older).alias("older"), F.lit(recent).alias("recent"))
                      for shift, older, recent in ((0, 0, 1), (span, 1, -1), (2 * span, -1, 0))])
    moved = stage(metrics.select(*kind, F.explode(moves).alias("m")).groupBy(*kind, "m.cell").agg(
        F.sum("m.older").cast("long").alias("older"), F.sum("m.recent").cast("long").alias("recent")))
    # A kind without a visit changes nothing, so both totals are carried over its gaps as zero.
    held = running(moved, kind, {"older": "older_count", "recent": "recent_count"})
    # A visit stays for two segments, so while a kind is held its next change lies within so many cells.
    near = with_neighbours(held, 0, 2 * span // step + 1)
    following = F.lead("cell").over(Window.partitionBy(*kind, "_block").orderBy("cell"))
    return (near.withColumn("hi", following - 1).where("_own and older_count + recent_count > 0")
            .select(*kind, F.col("cell").alias("lo"), "hi", "older_count", "recent_count"))


def weighted_records(metrics: DataFrame, timeline: DataFrame, p: Params = Params(), at: str = "window_start") -> DataFrame:
    """The joint history (type, service time) at each point: counts per segment, weight and share of the point's weight."""
    points = timeline.select("lab_id", F.col(at), floor_cell(micros(at), p.step_us).alias("cell"))
    held = record_intervals(metrics, p).withColumn("cell", F.explode(clock.cells(F.col("lo"), F.col("hi"))))
    weight = p.older_weight * F.col("older_count") + p.recent_weight * F.col("recent_count")
    rows = points.join(held, ["lab_id", "cell"]).withColumn("weight", weight.cast("double"))
    # A window holds the distinct kinds of half an hour.
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("lab_id", "cell", at))
    return rows.select("lab_id", at, "patient_type", "service_minutes", "older_count", "recent_count", "weight", share.alias("share"))
