"""Stateful hold policy over recommendation timelines, and what the policies cost."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waitline.functions.clock import MINUTE_US, floor_cell, micros
from waitline.functions.ordered import runs
from waitline.functions.scalars import percent_of, staffing_cost, window_hours
from waitline.functions.spread import by_work, running, with_neighbours
from waitline.labels import HOLD_STEPS, STAFF_CHANGES
from waitline.params import Params
from waitline.sources.tables import stage


def hold_step(at: int, asked: int, active: int, until: int, hold: int) -> tuple[str, int, int]:
    """One decision: (step name, active staff afterwards, end of the hold or -1 for none)."""
    if active == 0:
        return ("idle", 0, until) if asked == 0 else ("deploy", asked, at + hold)
    if asked > active:
        return "escalate", asked, at + hold
    if asked == active:
        return "keep", active, until
    if at < until:
        return "wait", active, until
    return ("release", 0, -1) if asked == 0 else ("reduce", asked, at + hold)


def stack_policies(timeline: DataFrame, columns: dict[str, str], *carried: str) -> DataFrame:
    """UNION ALL of one timeline per policy, from one recommendation column each."""
    options = F.array(*[F.struct(F.lit(name).alias("policy"),
                                 F.coalesce(F.col(c), F.lit(0)).cast("int").alias("instantaneous_recommendation"))
                        for name, c in columns.items()])
    return timeline.select("lab_id", "timestamp", *carried, F.explode(options).alias("o")).select(
        "lab_id", "timestamp", *carried, "o.*")


def episodes(steps: DataFrame, keys: Sequence[str], p: Params = Params()) -> DataFrame:
    """Cut each timeline where the policy must be idle, whatever came before.

    Holds are only set by a positive recommendation, so after a zero recommendation with no
    positive one during the hold time before it nothing is deployed. Rows between two such
    points form one independent `episode`.
    """
    keys = list(keys)
    step = p.step_us
    hold_us = p.hold_minutes * MINUTE_US
    reach = -(-hold_us // step)
    rows = steps.withColumn("_us", micros("timestamp")).withColumn("cell", floor_cell(F.col("_us"), step))
    rows = with_neighbours(rows, reach + 1, 0)
    order = Window.partitionBy(*keys, "_block").orderBy("_us")
    busy = F.max(F.when(F.col("instantaneous_recommendation") > 0, F.col("_us"))).over(
        order.rangeBetween(-hold_us, 0))
    rows = rows.withColumn("_busy", busy).filter("_own")
    idle = (F.col("instantaneous_recommendation") == 0) & (
        F.col("_busy").isNull() | (F.col("_us") - F.col("_busy") >= hold_us))
    rows = rows.withColumn("_idle", F.when(idle, F.col("cell"))).drop("_own", "_block", "_busy")
    # An episode is named by the last idle row before it.
    return running(rows, keys, {"_idle": "episode"}, how="max", order="_us", inclusive=False).drop("_idle", "cell")


def apply_hold_policy(steps: DataFrame, keys: Sequence[str] = ("policy", "lab_id"), p: Params = Params()) -> DataFrame:
    """Run the hold policy along each timeline.

    Rows are shuffled by episode and sorted, then read in order one batch at a time, so a task
    only ever holds the current state, and one endlessly busy lab is the only long episode.
    """
    keys = list(keys)
    # Finding episodes reads the steps twice, and behind them lie whole replays.
    steps = stage(steps)
    rows = episodes(steps, keys, p).fillna({"episode": -1})
    hold = p.hold_minutes * MINUTE_US
    out = [c for c in steps.columns]
    schema = rows.select(*out).schema
    for name, kind in (("step", "string"), ("staff_change", "integer"), ("active_additional_staff", "integer")):
        schema = schema.add(name, kind)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, active, until = None, 0, -1
        for batch in batches:
            times = batch.column("_us").to_pylist()
            asked = batch.column("instantaneous_recommendation").to_pylist()
            names, changes, actives = [], [], []
            for first, stop, key in runs(batch, [*keys, "episode"]):
                if key != here:
                    here, active, until = key, 0, -1
                for at, wanted in zip(times[first:stop], asked[first:stop]):
                    name, now, until = hold_step(at, wanted, active, until, hold)
                    names.append(name)
                    changes.append(now - active)
                    actives.append(now)
                    active = now
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in out], pa.array(names, pa.string()),
                 pa.array(changes, pa.int32()), pa.array(actives, pa.int32())],
                [*out, "step", "staff_change", "active_additional_staff"])

    walked = (by_work(rows, *keys, "episode").sortWithinPartitions(*keys, "episode", "_us")
              .select(*out, "episode", "_us").mapInArrow(walk, schema))
    action, reason = F.lit(None), F.lit(None)
    for name, (label, text) in HOLD_STEPS.items():
        action = F.when(F.col("step") == name, label).otherwise(action)
        reason = F.when(F.col("step") == name, text).otherwise(reason)
    return walked.withColumn("policy_action", action).withColumn("reason", reason).drop("step")


def resource_use(policy: DataFrame, p: Params = Params(), by: str = "policy") -> DataFrame:
    """Windows, staff units, hours, cost, peak and staffing changes per policy."""
    active = F.col("active_additional_staff")
    used = policy.groupBy(by).agg(
        F.count("*").alias("windows"), F.coalesce(F.sum(active), F.lit(0)).alias("staff_window_units"),
        F.avg(active).alias("average_extra_staff"), F.max(active).alias("peak_extra_staff"),
        F.count_if(F.col("policy_action").isin(*STAFF_CHANGES)).alias("change_actions"))
    return (used.withColumn("staff_minutes", F.col("staff_window_units") * p.window_minutes)
            .withColumn("staff_hours", window_hours(F.col("staff_window_units"), p.window_minutes))
            .withColumn("cost", staffing_cost(F.col("staff_hours"), p.hourly_cost)))


def policy_delta(resources: DataFrame, base: str, other: str) -> DataFrame:
    """Hours and cost avoided by one policy against another, in one row."""
    def value(policy: str, column: str) -> Column:
        return F.max(F.when(F.col("policy") == policy, F.col(column)))

    pair = resources.agg(value(base, "staff_hours").alias("base_hours"), value(other, "staff_hours").alias("other_hours"),
                         value(base, "cost").alias("base_cost"), value(other, "cost").alias("other_cost"))
    hours, cost = F.col("base_hours") - F.col("other_hours"), F.col("base_cost") - F.col("other_cost")
    return pair.select("*", hours.alias("staff_hours_avoided"), cost.alias("cost_avoided"),
                       percent_of(hours, F.col("base_hours")).alias("hours_reduction_percentage"),
                       percent_of(cost, F.col("base_cost")).alias("cost_reduction_percentage"))


def change_counts(policy: DataFrame) -> DataFrame:
    return (policy.filter(F.col("policy_action").isin(*STAFF_CHANGES))
            .groupBy("policy").agg(F.count("*").alias("changes")))


def compare_policies(full: DataFrame, p: Params = Params()) -> DataFrame:
    """Rule and counterfactual recommendations, both run through the hold policy."""
    carried = ("counterfactual_decision", "objective", "baseline_predicted_sla", "recommended_predicted_sla")
    steps = stack_policies(full, {"STATIC_RULE": "rule_additional_staff",
                                  "COUNTERFACTUAL": "model_additional_staff"}, *carried)
    return apply_hold_policy(steps, p=p)
