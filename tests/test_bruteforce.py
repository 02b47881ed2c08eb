"""Random visits: Spark results against plain restatements."""

import random
import time
from datetime import timedelta

import pytest
from helpers import (arrivals_between, at, fold_scores, heap_waits, minutes, random_visits, rounded, scorecard, state_jobs, visit,
                     visit_frame)
from pyspark.sql import functions as F

from waitline.functions.ranks import wait_scorecard
from waitline.functions.spread import running
from waitline.operators import counterfactual, forecast, gold, grid, lifecycle, policy, replay, windows
from waitline.params import Params
from waitline.sources import versions, visits

P = Params(staff_count=1, max_additional_staff=3, on_overflow="queue")


def test_waits_match_a_heap(spark):
    rng = random.Random(4)
    cases = [sorted([(rng.randint(0, 20), rng.randint(0, 9), rng.choice([None, rng.randint(0, 20)])) for _ in range(rng.randint(0, 25))],
                    key=lambda j: j[0]) for _ in range(80)]
    for jobs, levels in zip(cases, fold_scores(spark, cases, [1, 2, 3, 5])):
        for c, got in zip([1, 2, 3, 5], levels):
            assert list(got) == pytest.approx(list(scorecard(heap_waits([(float(x), float(y), z) for x, y, z in jobs], c))))


@pytest.fixture(scope="module")
def rows():
    return random_visits(260, 7, 6 * 60)


@pytest.fixture(scope="module")
def metrics(spark, rows):
    return lifecycle.patient_metrics(visit_frame(spark, rows)).cache()


@pytest.fixture(scope="module")
def points(metrics):
    return windows.operational_metrics(metrics).select("lab_id", "window_start").cache()


def test_snapshots(spark, rows, metrics):
    for keys, align in ((["lab_id"], "window"), (["lab_id"], "minute"), ([], "minute")):
        got = grid.queue_snapshots(metrics, P, keys, align).collect()
        assert got
        for r in got:
            mine = [v for v in rows if not keys or v["lab_id"] == r.lab_id]
            assert r.patients_waiting == sum(v["queue_entry_time"] <= r.timestamp < v["service_start_time"] for v in mine)
            assert r.patients_in_service == sum(v["service_start_time"] <= r.timestamp < v["service_end_time"] for v in mine)


def test_minute_anchor_misses_windows(spark):
    """A grid anchored at minute 3 never meets window starts; the default anchor does."""
    m = lifecycle.patient_metrics(visit_frame(spark, [visit(1, 3, 20, 5), visit(2, 8, 20, 5)]))
    om = windows.operational_metrics(m)
    waiting = lambda align: windows.operational_state(om, grid.queue_snapshots(m, P, align=align)).agg(
        F.sum("patients_waiting")).first()[0]
    assert waiting("minute") == 0 and waiting("window") > 0
    assert grid.queue_snapshots(m, P, align="minute").agg(F.min("timestamp")).first()[0] == at(3)


def test_snapshot_at_one_instant(rows, metrics):
    got = {r.lab_id: (r.patients_waiting, r.patients_in_service) for r in grid.snapshot_at(metrics, at(100)).collect()}
    for lab, pair in got.items():
        jobs = state_jobs(rows, lab, at(100))
        assert pair == (sum(w is not None for *_, w in jobs), sum(w is None for *_, w in jobs))


def test_staffing_sweep(rows, metrics, points):
    """Every window replays its own state and next half hour."""
    got = replay.staffing_sweep(metrics, points, P).collect()
    load = {(r.lab_id, r.window_start): r for r in replay.window_load(metrics, points, P).collect()}
    assert len(got) == points.count() == len(load)
    for r in got:
        assert r.initial_waiting == load[r.lab_id, r.window_start].initial_waiting
        assert r.already_breached == load[r.lab_id, r.window_start].already_breached
        assert r.future_arrivals == load[r.lab_id, r.window_start].future_arrivals
        t = r.window_start
        jobs = state_jobs(rows, r.lab_id, t)
        future = arrivals_between(rows, r.lab_id, t, at(minutes(at(0), t) + 30))
        jobs += [(minutes(t, v["arrival_time"]), minutes(v["service_start_time"], v["service_end_time"]), 0.0) for v in future]
        assert r.future_arrivals == len(future)
        for x in range(4):
            want = scorecard(heap_waits(jobs, 1 + x))
            assert [r.avg[x], r.p95[x], r.max[x], r.sla[x]] == pytest.approx(list(want), abs=1e-7)


def test_a_crowded_window_is_replayed_in_time_that_grows_with_its_jobs(spark):
    """200,000 customers in one half hour: seconds, where a growing copied list of waits takes minutes."""
    n = 200_000
    i, start = F.col("id"), F.lit(at(0)).cast("timestamp")
    m = spark.range(n).select(
        F.lit("LAB_A").alias("lab_id"), F.concat(F.lit("P"), i).alias("patient_id"), F.lit(3.0).alias("service_minutes"),
        *[(start + F.make_dt_interval(mins=F.lit(x), secs=(i % 1800).cast("decimal(18, 6)"))).alias(c) for c, x in (
            ("arrival_time", 0), ("queue_entry_time", 40), ("service_start_time", 50), ("service_end_time", 53))])
    points = spark.createDataFrame([("LAB_A", at(0)), ("LAB_A", at(-4000)), ("LAB_B", at(0))], "lab_id string, window_start timestamp")
    begun = time.monotonic()
    got = {(r.lab_id, r.window_start): r for r in replay.staffing_sweep(m, points, P).collect()}
    assert time.monotonic() - begun < 45
    assert len(got) == 3 and all(got[k].sla == [100.0] * 4 for k in (("LAB_A", at(-4000)), ("LAB_B", at(0))))
    r = got["LAB_A", at(0)]
    assert (r.initial_waiting, r.initial_in_service, r.future_arrivals) == (0, 0, n)
    jobs = [(x / 60, 3.0, 0.0) for x in sorted(j % 1800 for j in range(n))]
    for extra in range(4):
        assert [r.avg[extra], r.p95[extra], r.max[extra], r.sla[extra]] == pytest.approx(list(scorecard(heap_waits(jobs, 1 + extra))), abs=1e-6)


def test_episode_is_one_instant_of_the_report(metrics, points):
    instant = points.orderBy("window_start").first().window_start
    one = counterfactual.episode(metrics, points, instant, P)
    every = counterfactual.scenario_report(metrics, points, P).filter(F.col("window_start") == F.lit(instant))
    assert sorted(one.collect()) == sorted(every.collect())
    chosen = one.filter("selected").groupBy("lab_id").count().collect()
    assert chosen and all(r["count"] == 1 for r in chosen)


def test_hold_policy_on_long_sparse_timelines(spark):
    """Episodes change nothing: the result is that of walking each timeline from its start."""
    rng = random.Random(3)
    steps = []
    for lab in "AB":
        t = 0
        for _ in range(900):
            t += rng.choice([5, 5, 5, 10, 20, 400])
            steps.append(("X", lab, at(t), rng.choice([0, 0, 0, 1, 2]) if lab == "A" else rng.choice([1, 2, 3])))
    df = spark.createDataFrame(steps, "policy string, lab_id string, timestamp timestamp, instantaneous_recommendation int")
    got = {(r.lab_id, r.timestamp): (r.policy_action, r.active_additional_staff)
           for r in policy.apply_hold_policy(df, p=Params()).collect()}
    cut = policy.episodes(df, ["policy", "lab_id"]).select("lab_id", "episode").distinct().groupBy("lab_id").count()
    assert {r.lab_id: r["count"] for r in cut.collect()}["A"] > 20
    for lab in "AB":
        active, until = 0, None
        for _, _, t, asked in (s for s in steps if s[1] == lab):
            if active == 0:
                action = "NO_ACTION" if asked == 0 else "DEPLOY"
            elif asked > active:
                action = "ESCALATE"
            elif asked == active or t < until:
                action = "HOLD"
            else:
                action = "RELEASE" if asked == 0 else "DEESCALATE"
            if action in ("DEPLOY", "ESCALATE", "DEESCALATE"):
                active, until = asked, at(minutes(at(0), t) + 15)
            elif action == "RELEASE":
                active, until = 0, None
            assert got[lab, t] == (action, active)
    assert len(got) == len(steps)


def test_running_totals_across_blocks(spark):
    rng = random.Random(1)
    data = [(k, c, rng.randrange(5)) for k in "ab" for c in sorted(rng.sample(range(-700, 3000), 400))]
    df = spark.createDataFrame(data, "k string, cell long, n int")
    got = {(r.k, r.cell): (r.s, r.m) for r in running(running(df, ["k"], {"n": "s"}), ["k"], {"n": "m"}, how="max", inclusive=False).collect()}
    for k in "ab":
        total, top = 0, None
        for _, c, n in (d for d in data if d[0] == k):
            total += n
            assert got[k, c] == (total, top)
            top = n if top is None else max(top, n)


def test_arrival_counts_around_block_borders(spark):
    rng = random.Random(5)
    rows = [visit(i, rng.randrange(0, 3 * 1440 * 60) / 60, 3, 4, rng.choice(["LAB_A", "LAB_B"])) for i in range(900)]
    m = lifecycle.patient_metrics(visit_frame(spark, rows))
    points = windows.operational_metrics(m).select("lab_id", "window_start")
    got = forecast.arrivals_around(m, points, {"back": (-120, 0), "near": (-30, -15), "next": (0, 30)}).collect()
    assert len(got) == points.count()
    for r in got[::7]:
        t = minutes(at(0), r.window_start)
        for name, lo, hi in (("back", -120, 0), ("near", -30, -15), ("next", 0, 30)):
            assert r[name] == len(arrivals_between(rows, r.lab_id, at(t + lo), at(t + hi)))


def test_scorecard_of_a_large_group(spark):
    rng = random.Random(2)
    waits = [float(rng.choice([0, 1, 2.5, 15, 15.5, 40])) for _ in range(5001)]
    df = spark.createDataFrame([("hot", w) for w in waits] + [("one", 3.0)], "k string, w double")
    got = {r.k: r for r in wait_scorecard(df, ["k"], "w", 15.0, 95.0).collect()}
    want = scorecard(waits)
    r = got["hot"]
    assert [r.average_wait_minutes, r.p95_wait_minutes, r.max_wait_minutes, r.sla_percentage] == pytest.approx(list(want))
    assert got["one"].p95_wait_minutes == 3.0 and got["one"].meets_sla


def test_floor_index_differs_from_rank(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 11)], "k string, w double")
    assert wait_scorecard(df, ["k"], "w", 15.0, 95.0).first().p95_wait_minutes == 9.0
    assert df.agg(F.percentile_approx("w", 0.95)).first()[0] == 10.0


def test_gold_tables_are_refreshed_and_read_back(spark, tmp_path, rows):
    """Unfinished lifecycles stay out; a second refresh replaces all five tables."""
    root = str(tmp_path)
    lifecycles = visit_frame(spark, rows)
    open_ = lifecycles.limit(9).withColumn("departure_time", F.lit(None).cast("timestamp")).withColumn("patient_id", F.concat("patient_id", F.lit("x")))
    assert gold.refresh_tables(spark, lifecycles.limit(40), root, P) == 0
    assert gold.refresh_tables(spark, lifecycles.unionByName(open_), root, P) == 1
    with gold.snapshot(spark, root) as tables:
        stored = {name: df.cache() for name, df in tables.items()}
        assert all(df.count() > 0 for df in stored.values())
    m = lifecycle.patient_metrics(lifecycles, P)
    om, qs = windows.operational_metrics(m, P), grid.queue_snapshots(m, P)
    state = windows.operational_state(om, qs)
    want = dict(zip(gold.NAMES, (m, om, qs, state, counterfactual.staffing_decisions(state))))
    for name, df in want.items():
        assert sorted(map(str, stored[name].select(*df.columns).collect())) == sorted(map(str, df.collect())), name
    assert stored["patient_metrics"].count() == len(rows)


def test_a_reader_keeps_its_version_while_the_tables_are_refreshed(spark, tmp_path, rows):
    """All tables of a snapshot are of one version; files that nobody needs go, so ten refreshes take the place of two."""
    root = str(tmp_path)
    lifecycles = visit_frame(spark, rows)
    size = lambda: sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    few = lifecycles.where("patient_id < 'P0020'")
    gold.refresh_tables(spark, few, root, P)
    one = size()
    with gold.snapshot(spark, root) as tables:
        for _ in range(4):
            gold.refresh_tables(spark, lifecycles, root, P, keep=1)
        assert tables["patient_metrics"].count() == few.count()
        arrived = tables["operational_metrics"].agg(F.sum("patients_arrived")).first()[0]
        assert arrived == few.count() and tables["staffing_decisions"].count() == tables["operational_state"].count()
    for _ in range(5):
        gold.refresh_tables(spark, few, root, P, keep=2)
    assert versions.versions(spark, root) == [8, 9] and size() < 3 * one
    assert not list((tmp_path / versions.LEASES).glob("*.json"))


def test_tasks_grow_with_the_rows_of_the_table(spark, monkeypatch):
    """Neither the tasks that read events nor those behind a shuffle are a fixed number."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(visits, "ROWS_PER_TASK", 40)
    try:
        read = visits.visits(spark, "/root/testdata/sf0.001")
        assert read.rdd.getNumPartitions() == 25 == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert read.count() == 1000 and max(read.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < 120
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_recorded_order_decides_offline_twin(spark):
    schema = "patient_id string, lab_id string, event_type string, event_time timestamp, seq int"
    kinds = ["PATIENT_ARRIVAL", "REGISTRATION_COMPLETED", "QUEUE_ENTERED", "SERVICE_STARTED", "SERVICE_COMPLETED", "PATIENT_DEPARTED"]
    rows = [("P1", "L", k, at(i), i) for i, k in enumerate(kinds)]
    rows += [("P1", "L", "QUEUE_ENTERED", at(1.5), 9), ("P2", "L", "PATIENT_ARRIVAL", at(0), 10)]
    df = spark.createDataFrame(rows, schema)
    got = lifecycle.recorded_journeys(df, "seq").collect()
    assert [(r.patient_id, r.queue_wait_minutes) for r in got] == [("P1", 1.5)]
    assert rounded([tuple(r) for r in lifecycle.wait_summary(lifecycle.wait_pairs(df, "seq")).collect()]) == [(1, 1.5, 1.5, 1)]


def test_weighted_records_against_lists(spark):
    """Counts and weights of (type, service time) in both segments before each point, also across day blocks."""
    rows = random_visits(150, 5, 300) + [visit(900 + i, 1438 + i, 3, 6) for i in range(4)]
    m = lifecycle.patient_metrics(visit_frame(spark, rows), P)
    grid_points = [(lab, at(5 * i)) for lab in ("LAB_A", "LAB_B") for i in range(300)]
    got = {}
    for r in forecast.weighted_records(m, spark.createDataFrame(grid_points, "lab_id string, window_start timestamp"), P).collect():
        got[r.lab_id, r.window_start, r.patient_type, r.service_minutes] = (r.older_count, r.recent_count, r.weight, round(r.share, 9))
    want = {}
    for lab, t in grid_points:
        found = {}
        for v in rows:
            age = minutes(v["arrival_time"], t)
            if v["lab_id"] == lab and 0 < age <= 30:
                key = lab, t, v["patient_type"], minutes(v["service_start_time"], v["service_end_time"])
                found.setdefault(key, [0, 0])[age <= 15] += 1
        total = sum(o * P.older_weight + n * P.recent_weight for o, n in found.values())
        want |= {k: (o, n, o * P.older_weight + n * P.recent_weight, round((o * P.older_weight + n * P.recent_weight) / total, 9))
                 for k, (o, n) in found.items()}
    assert got == want and len(got) > 500


def test_instants_off_the_grid(spark):
    """Edges to the microsecond, short and very long spans, instants without anybody, repeated instants."""
    rng = random.Random(3)
    rows = random_visits(120, 6, 200) + [visit(800, 10, 6000, 4), visit(801, 20, 0, 90_000), visit(802, 5, 0, 0)]
    m = lifecycle.patient_metrics(visit_frame(spark, rows), P)
    edges = [v[c] + timedelta(microseconds=d) for v in rows[::9] + rows[-3:] for c in ("queue_entry_time", "service_start_time", "service_end_time")
             for d in (-1, 0, 1)]
    asked = sorted({(rng.choice(["LAB_A", "LAB_B"]), t) for t in edges + [at(rng.uniform(-100, 95_000)) for _ in range(60)]})
    instants = spark.createDataFrame(asked + asked[:5], "lab_id string, timestamp timestamp")
    waiting = lambda v, t: v["queue_entry_time"] <= t < v["service_start_time"]
    serving = lambda v, t: v["service_start_time"] <= t < v["service_end_time"]
    of = lambda lab: [v for v in rows if v["lab_id"] == lab]
    want = [(lab, t, sum(waiting(v, t) for v in of(lab)), sum(serving(v, t) for v in of(lab))) for lab, t in asked]
    assert sorted(map(tuple, grid.queue_at(m, instants).collect())) == want
    us = lambda a, b: (b - a) // timedelta(microseconds=1)
    roles = sorted((r.lab_id, r.timestamp, r.role, r.patient_id, r.microseconds) for r in grid.episode_at(m, instants, P).collect())
    expected = []
    for lab, t in asked:
        for v in of(lab):
            expected += [(lab, t, "WAITING", v["patient_id"], us(v["queue_entry_time"], t))] if waiting(v, t) else []
            expected += [(lab, t, "SERVING", v["patient_id"], us(t, v["service_end_time"]))] if serving(v, t) else []
            ahead = us(t, v["arrival_time"])
            expected += [(lab, t, "ARRIVING", v["patient_id"], ahead)] if 0 <= ahead < 30 * 60_000_000 else []
    assert roles == sorted(expected) and len(roles) > 100


def test_rolled_up_percentile_is_near_the_exact_rank(spark):
    """Sketches of windows merged to a day: within a thousandth of the ranks, far beyond what a sketch holds exactly."""
    m = spark.range(60_000).select(
        F.lit("L").alias("lab_id"), (F.lit(at(0)).cast("timestamp") + F.make_dt_interval(mins=(F.col("id") % 900).cast("int"))).alias("arrival_time"),
        (F.pmod(F.col("id") * 7919, F.lit(60_000)) / 100).alias("queue_wait_minutes"))
    hours = windows.rolled_up_percentile(windows.wait_sketches(m, P), "1 hour").collect()
    assert sum(r.patients for r in hours) == 60_000 and len(hours) == 15
    days = windows.rolled_up_percentile(windows.wait_sketches(m, P), "1 day").collect()
    assert [r.patients for r in days] == [60_000] and abs(days[0].p95_queue_wait_minutes - 570) <= 0.6


def test_points_off_the_grid_are_not_moved(spark, rows):
    m = lifecycle.patient_metrics(visit_frame(spark, rows), P)
    point = spark.createDataFrame([("LAB_A", at(7))], "lab_id string, window_start timestamp")
    for run in (replay.staffing_sweep, replay.window_load):
        with pytest.raises(Exception, match="off the grid"):
            run(m, point, P).collect()


def shuffled_rows(df):
    """Rows of each shuffle of a query that has been run."""
    out, nodes = [], [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            nodes.append(node.plan())
        elif node.nodeName() == "Exchange":
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_a_visit_is_shuffled_once_for_its_episode(spark):
    """It goes to the one or two bins it lies in, not to those of each role."""
    rows = random_visits(400, 9, 600)
    m = lifecycle.patient_metrics(visit_frame(spark, rows), P)
    instants = spark.createDataFrame([("LAB_A", at(x)) for x in (30, 31, 200)], "lab_id string, timestamp timestamp")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = grid.episode_at(m, instants, P)
        plan.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert 400 <= max(shuffled_rows(plan)) <= 800


def test_roles_of_visits_whose_times_are_not_in_order(spark):
    """Queued on arrival, served before queueing, or without some times: every role that holds at a moment is a row."""
    times = [(5, 5, 9, 12), (5, 8, 6, 12), (5, 2, 9, 4), (None, 3, 8, 9), (5, None, 6, 8), (5, 6, None, 8), (5, 6, 7, None), (5, 7, 7, 7)]
    m = spark.createDataFrame([(f"P{i}", "LAB_A", "WALK_IN", 1.0, *[None if x is None else at(x) for x in row]) for i, row in enumerate(times)],
                              "patient_id string, lab_id string, patient_type string, service_minutes double, arrival_time timestamp, "
                              "queue_entry_time timestamp, service_start_time timestamp, service_end_time timestamp")
    moments = [x / 2 for x in range(-60, 30)]
    instants = spark.createDataFrame([("LAB_A", at(x)) for x in moments], "lab_id string, timestamp timestamp")
    got = sorted((r.patient_id, r.timestamp, r.role, r.microseconds // 1_000_000) for r in grid.episode_at(m, instants, P).collect())
    want = []
    for i, (a, q, b, d) in enumerate(times):
        for t in moments:
            want += [(f"P{i}", at(t), "WAITING", (t - q) * 60)] if None not in (q, b) and q <= t < b else []
            want += [(f"P{i}", at(t), "SERVING", (d - t) * 60)] if None not in (b, d) and b <= t < d else []
            want += [(f"P{i}", at(t), "ARRIVING", (a - t) * 60)] if a is not None and 0 <= a - t < 30 else []
    assert got == sorted(want)
