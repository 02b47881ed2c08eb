"""Recommendations from staffing sweeps, and the backtests built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waitline.functions.scalars import rule_versus_model, severity, severity_lookup
from waitline.labels import DECISIONS
from waitline.operators.replay import staffing_sweep
from waitline.params import Params

EPSILON = 1e-9


def staffing_decisions(state: DataFrame) -> DataFrame:
    """Rule-based staffing recommendation per window."""
    ladder = severity(F.col("patients_waiting"), F.col("sla_compliance_rate"),
                      F.col("p95_queue_wait_minutes"), F.col("utilization_percentage"))
    return state.withColumn("severity", ladder).select(
        F.col("window_start").alias("timestamp"), "lab_id", "patients_waiting", "patients_in_service",
        "utilization_percentage", F.col("avg_queue_wait_minutes").alias("average_wait_minutes"),
        F.col("p95_queue_wait_minutes").alias("p95_wait_minutes"), "sla_compliance_rate",
        (F.col("severity") != "NORMAL").alias("intervention_required"), "severity",
        severity_lookup(F.col("severity"), 0).alias("additional_staff"),
        severity_lookup(F.col("severity"), 1).alias("reason"))


def recoverability(breached: Column, waiting: Column, future: Column, p: Params = Params()) -> Column:
    """Best SLA share still possible when waits already over the limit cannot be undone."""
    total = waiting + future
    best = F.when(total == 0, F.lit(100.0)).otherwise((total - breached) / total * 100)
    return F.struct(total.alias("total_patients"), breached.alias("already_breached_patients"),
                    best.alias("maximum_possible_sla_percentage"),
                    (best >= p.target_sla_percentage).alias("is_recoverable"))


def scenario_array(p: Params = Params()) -> Column:
    """Scorecards per extra staff from the parallel arrays of a sweep."""
    zipped = F.arrays_zip("avg", "p95", "max", "sla")
    return F.transform(zipped, lambda x, i: F.struct(
        (F.lit(p.staff_count) + i).alias("staff_count"), i.alias("additional_staff"),
        x["avg"].alias("average_wait_minutes"), x["p95"].alias("p95_wait_minutes"),
        x["max"].alias("max_wait_minutes"), x["sla"].alias("sla_percentage"),
        (x["sla"] >= F.lit(p.target_sla_percentage)).alias("meets_sla")))


def damage_control(scenarios: Column, p: Params = Params()) -> Column:
    """Walk the levels upwards from the selected one: a higher SLA wins; on equal SLA a level
    wins only when it cuts P95 by the minimum gain."""
    def step(kept, level):
        gain = level["sla_percentage"] - kept["sla_percentage"]
        cut = kept["p95_wait_minutes"] - level["p95_wait_minutes"]
        better = (gain > EPSILON) | ((F.abs(gain) <= EPSILON) & (cut >= p.min_p95_gain_minutes))
        return F.when(better, level).otherwise(kept)

    return F.aggregate(F.slice(scenarios, F.lit(2), F.greatest(F.size(scenarios) - 1, F.lit(0))),
                       F.element_at(scenarios, 1), step)


def recommend(sweep: DataFrame, p: Params = Params()) -> DataFrame:
    """Decision, selected level and gains over the baseline for each row of a sweep."""
    rows = (sweep.withColumn("scenarios", scenario_array(p))
            .withColumn("r", recoverability(F.col("already_breached"), F.col("initial_waiting"),
                                            F.col("future_arrivals"), p)))
    feasible = F.element_at(F.filter("scenarios", lambda s: s["meets_sla"]), 1)
    rows = rows.withColumn("feasible", F.when(
        F.col("r.is_recoverable") & F.exists("scenarios", lambda s: s["meets_sla"]), feasible))
    rows = rows.withColumn("chosen", F.coalesce("feasible", damage_control(F.col("scenarios"), p)))
    rows = rows.withColumn("decision", F.when(~F.col("r.is_recoverable"), "DAMAGE_CONTROL")
                           .when(F.col("feasible").isNull(), "SEARCH_LIMIT_REACHED")
                           .when(F.col("feasible.additional_staff") == 0, "NO_ACTION_REQUIRED")
                           .otherwise("STAFFING_INTERVENTION"))
    objective, reason = F.lit(None), F.lit(None)
    for name, (goal, why) in DECISIONS.items():
        objective = F.when(F.col("decision") == name, goal).otherwise(objective)
        reason = F.when(F.col("decision") == name, why).otherwise(reason)
    base = F.element_at("scenarios", 1)
    rows = rows.withColumn("objective", objective).withColumn("reason", reason).withColumn("base", base)
    return (rows
            .withColumn("maximum_possible_sla_percentage", F.col("r.maximum_possible_sla_percentage"))
            .withColumn("sla_improvement_percentage_points",
                        F.col("chosen.sla_percentage") - F.col("base.sla_percentage"))
            .withColumn("p95_improvement_minutes",
                        F.col("base.p95_wait_minutes") - F.col("chosen.p95_wait_minutes"))
            .drop("r", "feasible", "avg", "p95", "max", "sla"))


def with_rule(timeline: DataFrame, decisions: DataFrame, keys: Sequence[str] = ("lab_id",)) -> DataFrame:
    """Attach the rule's recommendation; windows without one count as NORMAL with no extra staff."""
    rule = decisions.select(*keys, F.col("timestamp").alias("window_start"),
                            F.col("severity").alias("_severity"), F.col("additional_staff").alias("_extra"))
    return (timeline.join(rule, [*keys, "window_start"], "left")
            .withColumn("rule_severity", F.coalesce("_severity", F.lit("NORMAL")))
            .withColumn("rule_additional_staff", F.coalesce("_extra", F.lit(0)))
            .drop("_severity", "_extra"))


def full_timeline(metrics: DataFrame, state: DataFrame, decisions: DataFrame, p: Params = Params()) -> DataFrame:
    """Counterfactual recommendation next to the rule for every window of the timeline."""
    points = state.select("lab_id", "window_start")
    best = recommend(staffing_sweep(metrics, points, p), p)
    rows = with_rule(best, decisions)
    return rows.select(
        F.col("window_start").alias("timestamp"), "lab_id", "rule_severity", "rule_additional_staff",
        F.col("decision").alias("counterfactual_decision"), "objective",
        F.col("chosen.additional_staff").alias("model_additional_staff"),
        F.col("chosen.staff_count").alias("model_total_staff"),
        "initial_waiting", "initial_in_service", "future_arrivals",
        F.col("base.sla_percentage").alias("baseline_predicted_sla"),
        F.col("base.p95_wait_minutes").alias("baseline_predicted_p95_wait"),
        F.col("chosen.sla_percentage").alias("recommended_predicted_sla"),
        F.col("chosen.p95_wait_minutes").alias("recommended_predicted_p95_wait"),
        "maximum_possible_sla_percentage",
        F.col("already_breached").alias("already_breached_patients"),
        "sla_improvement_percentage_points", "p95_improvement_minutes")


def intervention_backtest(metrics: DataFrame, decisions: DataFrame, p: Params = Params()) -> DataFrame:
    """Where the rule asked for staff: what the replay would have recommended instead."""
    asked = decisions.filter("intervention_required")
    points = asked.select("lab_id", F.col("timestamp").alias("window_start"))
    best = recommend(staffing_sweep(metrics, points, p), p).withColumnRenamed("window_start", "timestamp")
    best = best.drop("reason").join(asked.select(
        "lab_id", "timestamp", "severity", "additional_staff"), ["lab_id", "timestamp"])
    chosen, base = F.col("chosen"), F.col("base")
    return best.select(
        "timestamp", "lab_id", F.col("severity").alias("rule_severity"),
        F.col("additional_staff").alias("rule_additional_staff"),
        F.col("decision").alias("counterfactual_decision"), "objective",
        chosen["additional_staff"].alias("model_additional_staff"),
        chosen["staff_count"].alias("model_total_staff"),
        rule_versus_model(F.col("decision"), F.col("additional_staff"), chosen["additional_staff"]).alias("comparison"),
        "initial_waiting", "initial_in_service", "future_arrivals",
        base["sla_percentage"].alias("baseline_predicted_sla"),
        base["p95_wait_minutes"].alias("baseline_predicted_p95_wait"),
        base["average_wait_minutes"].alias("baseline_predicted_avg_wait"),
        base["max_wait_minutes"].alias("baseline_predicted_max_wait"),
        chosen["sla_percentage"].alias("recommended_predicted_sla"),
        chosen["p95_wait_minutes"].alias("recommended_predicted_p95_wait"),
        chosen["average_wait_minutes"].alias("recommended_predicted_avg_wait"),
        chosen["max_wait_minutes"].alias("recommended_predicted_max_wait"),
        "maximum_possible_sla_percentage", F.col("already_breached").alias("already_breached_patients"),
        "sla_improvement_percentage_points", "p95_improvement_minutes")


def scenario_report(metrics: DataFrame, points: DataFrame, p: Params = Params()) -> DataFrame:
    """Every staffing scenario of each timeline point, with the recommended one marked."""
    best = recommend(staffing_sweep(metrics, points, p), p)
    return best.select("lab_id", "window_start", "decision", F.explode("scenarios").alias("s"), "chosen").select(
        "lab_id", "window_start", "decision", "s.*",
        (F.col("s.additional_staff") == F.col("chosen.additional_staff")).alias("selected"))


def episode(metrics: DataFrame, state: DataFrame, instant, p: Params = Params()) -> DataFrame:
    """The scenario report of the windows starting at one instant."""
    at = F.lit(instant).cast(state.schema["window_start"].dataType)
    points = state.filter(F.col("window_start") == at).select("lab_id", "window_start")
    return scenario_report(metrics, points, p)


def sweep_rows(sweep: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per timeline point and extra staff."""
    return sweep.select("lab_id", "window_start", F.explode(scenario_array(p)).alias("s")).select(
        "lab_id", "window_start", "s.*")


def staffing_totals(backtest: DataFrame) -> DataFrame:
    """Rule and model staffing over the windows where the model found a level."""
    solved = backtest.filter(F.col("model_additional_staff").isNotNull())
    return solved.agg(F.count("*").alias("windows"),
                      F.sum("rule_additional_staff").alias("rule_total_staff"),
                      F.sum("model_additional_staff").alias("model_total_staff"),
                      F.avg("rule_additional_staff").alias("rule_average_staff"),
                      F.avg("model_additional_staff").alias("model_average_staff"))
