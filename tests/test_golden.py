"""Small cases with known answers."""

import pytest
from helpers import at, fold_scores, visit, visit_frame
from pyspark.sql import functions as F

from waitline.functions import scalars
from waitline.functions.mmc import mmc
from waitline.operators import comparison, counterfactual, forecast, lifecycle, policy, replay, windows
from waitline.params import Params


def one(df):
    return df.collect()[0]


def test_mmc(spark):
    df = spark.createDataFrame([(30.0, 10.0, 4), (40.0, 10.0, 4), (0.0, 10.0, 4), (5.0, 10.0, 1)], "l double, m double, c int")
    rows = df.select("l", mmc(F.col("l"), F.col("m"), F.col("c")).alias("r")).collect()
    r = rows[0].r
    assert r.utilization == pytest.approx(0.75)
    assert r.probability_wait == pytest.approx(0.5094339623)
    assert r.average_queue_length == pytest.approx(1.5283018868)
    assert r.average_wait_minutes == pytest.approx(3.0566037736)
    assert rows[1].r is None and rows[2].r is None
    assert rows[3].r.probability_wait == pytest.approx(0.5)


def test_replay_three_together(spark):
    assert fold_scores(spark, [[(0, 10, 0)] * 3], [2]) == [[(pytest.approx(10 / 3), 0.0, 10.0, 100.0)]]


def test_replay_keeps_accrued_wait(spark):
    assert fold_scores(spark, [[(0, 5, None), (0, 4, 12)]], [1])[0][0][2] == 17.0


def test_replay_without_jobs(spark):
    assert fold_scores(spark, [[]], [1, 2]) == [[(0.0, 0.0, 0.0, 100.0)] * 2]


def test_damage_control_case(spark):
    """Two customers waiting for 20 minutes and one arrival cannot be recovered."""
    rows = [visit(1, -22, 25, 5), visit(2, -22, 25, 5), visit(3, 1, 0, 5)]
    m = lifecycle.patient_metrics(visit_frame(spark, rows))
    points = spark.createDataFrame([("LAB_A", at(0))], "lab_id string, window_start timestamp")
    p = Params(max_additional_staff=6)
    r = one(counterfactual.recommend(replay.staffing_sweep(m, points, p), p))
    assert r.decision == "DAMAGE_CONTROL" and r.already_breached == 2 and len(r.scenarios) == 7
    assert r.maximum_possible_sla_percentage == pytest.approx(100 / 3)


@pytest.mark.parametrize("levels, chosen", [
    ([(80, 18), (80, 17.4), (80, 17)], 0),
    ([(80, 18), (80, 17.5), (80, 15.5), (80, 15)], 2),
    ([(80, 18), (85, 18), (90, 18)], 2),
])
def test_damage_control_fold(spark, levels, chosen):
    rows = [(i, float(s), float(p)) for i, (s, p) in enumerate(levels)]
    df = spark.createDataFrame([(rows,)], "s array<struct<additional_staff:int,sla_percentage:double,p95_wait_minutes:double>>")
    assert one(df.select(counterfactual.damage_control(F.col("s")).alias("r"))).r.additional_staff == chosen


def test_recoverability(spark):
    df = spark.createDataFrame([(3, 4, 6), (0, 0, 0), (0, 1, 0)], "b int, w int, f int")
    r = [x.r for x in df.select(counterfactual.recoverability(F.col("b"), F.col("w"), F.col("f")).alias("r")).collect()]
    assert (r[0].total_patients, r[0].maximum_possible_sla_percentage, r[0].is_recoverable) == (10, 70.0, False)
    assert r[1].maximum_possible_sla_percentage == 100.0 and r[2].is_recoverable


def test_wait_of_exactly_the_limit_is_within(spark):
    m = lifecycle.patient_metrics(visit_frame(spark, [visit(1, 0, 15, 5), visit(2, 0, 16, 5)]))
    assert {r.patient_id: r.sla_breached for r in m.collect()} == {"P0001": False, "P0002": True}


@pytest.mark.parametrize("waiting, sla, p95, util, expected", [
    (0, 100.0, 1.0, 50.0, "NORMAL"), (1, 100.0, 1.0, 100.0, "WATCH"), (4, 100.0, 1.0, 0.0, "HIGH"),
    (0, 100.0, 10.0, 0.0, "HIGH"), (8, 100.0, 1.0, 0.0, "CRITICAL"), (0, 79.9, 1.0, 0.0, "CRITICAL"),
    (0, 100.0, 20.0, 0.0, "CRITICAL"), (0, 100.0, None, 100.0, "NORMAL")])
def test_rule_ladder(spark, waiting, sla, p95, util, expected):
    df = spark.createDataFrame([(waiting, sla, p95, util)], "w int, s double, p double, u double")
    assert one(df.select(scalars.severity(F.col("w"), F.col("s"), F.col("p"), F.col("u")).alias("x"))).x == expected


def hold(spark, steps, **kw):
    df = spark.createDataFrame([("X", "LAB_A", at(m), a) for m, a in steps],
                               "policy string, lab_id string, timestamp timestamp, instantaneous_recommendation int")
    rows = sorted(policy.apply_hold_policy(df, p=Params(**kw)).collect(), key=lambda r: r.timestamp)
    return [(r.policy_action, r.staff_change, r.active_additional_staff) for r in rows]


def test_hold_policy(spark):
    assert hold(spark, [(0, 1), (5, 0), (10, 2), (20, 1), (25, 1), (30, 0), (45, 0), (50, 0)]) == [
        ("DEPLOY", 1, 1), ("HOLD", 0, 1), ("ESCALATE", 1, 2), ("HOLD", 0, 2), ("DEESCALATE", -1, 1), ("HOLD", 0, 1),
        ("RELEASE", -1, 0), ("NO_ACTION", 0, 0)]
    assert hold(spark, [(0, 1), (15, 0)]) == [("DEPLOY", 1, 1), ("RELEASE", -1, 0)]


def test_forecast_errors(spark):
    df = spark.createDataFrame([(10.0, 12.0), (20.0, 18.0)], "actual double, predicted double")
    r = one(forecast.forecast_errors(df, []))
    assert (r.observations, r.mae, r.bias, r.rmse) == (2, 2.0, 0.0, 2.0) and r.mape == pytest.approx(15)
    none = one(forecast.forecast_errors(df.filter("actual < 0"), []))
    assert (none.observations, none.mae, none.mape) == (0, 0.0, None)


def test_rates(spark):
    r = one(spark.range(1).select(forecast.weighted_rate(F.lit(3), F.lit(6)).alias("w"), forecast.trend_rate(F.lit(9), F.lit(0)).alias("t"),
                                  forecast.rolling_rate(F.lit(6), 60).alias("r")))
    assert r.w == pytest.approx((3 / 15 + 2 * 6 / 15) / 3) and r.t == 0.0 and r.r == pytest.approx(0.1)


def test_split_service_utilisation(spark):
    """A ten-minute service across two windows counts five minutes in each."""
    m = lifecycle.patient_metrics(visit_frame(spark, [visit(1, 53, 0, 10)]))
    w = windows.window_metrics(m, Params(staff_count=1), 60, at(0), at(120)).orderBy("window_start").collect()
    assert [r.utilization for r in w] == [pytest.approx(5 / 60)] * 2
    assert [(r.arrivals, r.patients_served) for r in w] == [(1, 0), (0, 1)]


def test_clipped_last_window(spark):
    m = lifecycle.patient_metrics(visit_frame(spark, [visit(1, 61, 4, 10), visit(2, 70, 9, 5)]))
    w = windows.window_metrics(m, Params(staff_count=4), 60, at(0), at(90)).orderBy("window_start").collect()
    assert len(w) == 2 and w[1].window_end == at(90) and w[1].arrivals == 2
    assert (w[1].average_queue_wait_minutes, w[1].maximum_queue_wait_minutes) == (6.5, 9.0)
    assert w[1].utilization == pytest.approx(15 / 240)
    assert w[0].utilization == 0.0 and w[0].arrivals == 0


def test_theory_branches(spark):
    rows = [("A", at(0), at(30), 10, 1, 5.0, 3.0), ("A", at(30), at(60), 0, 1, 5.0, 2.0), ("A", at(60), at(90), 2, 0, 0.0, 1.0),
            ("A", at(90), at(120), 40, 1, 60.0, 9.0)]
    w = spark.createDataFrame(rows, "lab_id string, window_start timestamp, window_end timestamp, arrivals int, patients_served int, "
                                    "average_service_time_minutes double, average_queue_wait_minutes double")
    r = comparison.compare(w, 4).orderBy("window_start").collect()
    assert (r[0].arrival_rate_per_hour, r[0].service_rate_per_hour) == (20.0, 12.0)
    assert r[0].theoretical_utilization == pytest.approx(20 / 48)
    assert (r[1].theoretical_wait_minutes, r[1].wait_difference_minutes, r[1].relative_error) == (0.0, -2.0, 0.0)
    assert (r[2].system_stable, r[2].theoretical_wait_minutes, r[2].arrival_rate_per_hour) == (True, None, 0.0)
    assert not r[3].system_stable
    s = one(comparison.validation_summary(comparison.compare(w, 4)))
    assert (s.total_windows, s.stable_windows, s.unstable_windows) == (4, 2, 2)


def test_validation_summary(spark):
    rows = [(True, 2.0, 3.0), (True, 4.0, 5.0), (False, None, 9.0)]
    df = spark.createDataFrame(rows, "system_stable boolean, theoretical_wait_minutes double, observed_wait_minutes double")
    s = one(comparison.validation_summary(df))
    assert tuple(s) == (3, 2, 1, 1.0, 1.0, 1.0, 3.0, 4.0)


def test_cost(spark):
    df = spark.createDataFrame([(2.25,)], "h double")
    assert one(df.select(scalars.staffing_cost(F.col("h"), 35.0).alias("c"))).c == 78.75
    with pytest.raises(ValueError):
        scalars.staffing_cost(F.col("h"), -1.0)
    with pytest.raises(Exception, match="hours of staff below 0"):
        df.select(scalars.staffing_cost(-F.col("h"), 35.0)).collect()


def test_overflow_is_an_error_by_default(spark):
    rows = [visit(i, -5, 0, 10) for i in range(3)]
    m = lifecycle.patient_metrics(visit_frame(spark, rows))
    points = spark.createDataFrame([("LAB_A", at(0))], "lab_id string, window_start timestamp")
    with pytest.raises(Exception, match="more customers in service than stations"):
        replay.staffing_sweep(m, points, Params(staff_count=2)).collect()
    assert replay.staffing_sweep(m, points, Params(staff_count=2, on_overflow="queue")).count() == 1


@pytest.mark.parametrize("bad", [{"staff_count": 0}, {"queue_sla_minutes": 0}, {"target_sla_percentage": 101}, {"older_weight": 0},
                                 {"hourly_cost": -1}, {"trend_strength": -0.1}, {"segment_minutes": 7},
                                 {"on_overflow": "drop"}])
def test_parameter_checks(bad):
    with pytest.raises(ValueError):
        Params(**bad)


def test_rule_versus_model(spark):
    rows = [("DAMAGE_CONTROL", 1, 1), ("STAFFING_INTERVENTION", 2, 1), ("STAFFING_INTERVENTION", 1, 2), ("NO_ACTION_REQUIRED", 0, 0),
            ("STAFFING_INTERVENTION", 1, None)]
    df = spark.createDataFrame(rows, "d string, r int, m int")
    got = [x.c for x in df.select(scalars.rule_versus_model(F.col("d"), F.col("r"), F.col("m")).alias("c")).collect()]
    assert got == ["DAMAGE_CONTROL", "RULE_OVERSTAFFS", "RULE_UNDERSTAFFS", "ALIGNED", "UNKNOWN"]
