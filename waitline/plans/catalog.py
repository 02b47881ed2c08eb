"""Named queries over the driver's tables: one entry per operator family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waitline.functions.mmc import mmc
from waitline.functions.ranks import wait_scorecard
from waitline.functions.clock import micros
from waitline.operators import comparison, counterfactual, forecast, gold, grid, ingest, lifecycle, policy, replay, windows
from waitline.params import Params
from waitline.plans import streams
from waitline.sources import versions
from waitline.sources.events import bronze_records, publishable
from waitline.sources.session import ship_package
from waitline.sources.tables import discard_later, head, stage, workspace
from waitline.sources.visits import visit_events, visit_records, visits

# One station per lab, so that queues build up on the test tables; the visit view does not
# bound how many are served at once, so the surplus queues for a station in the replays.
P = Params(staff_count=1, on_overflow="queue")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def settle(df: DataFrame) -> DataFrame:
    """Comparable output: doubles rounded to 6 digits, timestamps without zone."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            c = F.round(c, 6)
        elif isinstance(field.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(field.name))
    return df.select(*out)


def query(build: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship_package(spark)
        return settle(build(spark, folder))

    run.__name__, run.__doc__ = build.__name__, build.__doc__
    QUERIES[build.__name__] = run
    return run


# Tables the queries share -------------------------------------------------------------------

def metrics(s, d):
    return lifecycle.patient_metrics(visits(s, d), P)


def operational(s, d):
    return windows.operational_metrics(metrics(s, d), P)


def snapshots(s, d):
    return grid.queue_snapshots(metrics(s, d), P)


def state(s, d):
    return windows.operational_state(operational(s, d), snapshots(s, d))


def decisions(s, d):
    return counterfactual.staffing_decisions(state(s, d))


def state_events(s, d):
    """Silver events with what lifecycles need, so that no other column is shuffled."""
    return ingest.silver(visit_records(s, d), P, columns=("event_type", "event_time", *lifecycle.KEYS, *lifecycle.ATTRIBUTES))


def points(s, d):
    return operational(s, d).select("lab_id", "window_start")


def arrivals(s, d):
    """Arrival cells and the timeline points they make, from one scan."""
    cells = forecast.arrival_cells(metrics(s, d), P)
    return cells, forecast.cell_points(cells, P)


def indexed(cells):
    return forecast.timeline_index(forecast.cell_points(cells, P, "timestamp"), P)


def full(s, d):
    st = stage(state(s, d))
    return counterfactual.full_timeline(metrics(s, d), st, counterfactual.staffing_decisions(st), P)


def backtest(s, d):
    return counterfactual.intervention_backtest(metrics(s, d), stage(decisions(s, d)), P)


def policies(s, d):
    return policy.compare_policies(full(s, d), P)


def half_hours(s, d):
    return windows.window_metrics(metrics(s, d), P, 30)


# Ingest ----------------------------------------------------------------------------------------

@query
def quarantined_records(s, d):
    """Parse, validate and keep what cannot be used, with the reason."""
    return ingest.rejected(ingest.parse(visit_records(s, d))).select(
        "topic", "partition", "offset", "event_key", "quarantine_reason")


@query
def quarantine_counts(s, d):
    return windows.counts_by(ingest.rejected(ingest.parse(visit_records(s, d))), "quarantine_reason")


@query
def accepted_events(s, d):
    """Flattened valid events with lag and lateness."""
    return ingest.with_lag(ingest.accepted(ingest.parse(visit_records(s, d))), P).select(
        "event_id", "event_type", "patient_id", "lab_id", "event_time", "patient_type", "priority", "staff_id",
        "offset", "event_lag_seconds", "is_late")


@query
def silver_events(s, d):
    """Accepted events, the first record of each event_id."""
    return ingest.silver(visit_records(s, d), P, columns=("event_id", "event_type", "patient_id", "lab_id", "event_time", "offset",
                                                          "event_lag_seconds", "is_late"))


@query
def event_window_counts(s, d):
    needed = ("event_type", "lab_id", "event_time", "event_lag_seconds", "is_late")
    return windows.event_counts(ingest.silver(visit_records(s, d), P, columns=needed), P)


def published(s, d):
    e = visit_events(s, d).select("event_id", "event_type", "patient_id", "lab_id", "priority", F.lit(None).cast("string").alias("appointment_id"))
    return publishable(e)


def topic_records(s, d):
    number = F.regexp_extract("key", "^P([0-9]+)_", 1).cast("long")
    return published(s, d).select(
        F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.lit("visits").alias("topic"),
        (number % 4).cast("int").alias("partition"), number.alias("offset"), F.timestamp_seconds(number).alias("timestamp"))


@query
def published_events(s, d):
    """Key/value rows as they go to a topic; fields without a value are written as null."""
    return published(s, d)


@query
def bronze_envelope(s, d):
    """Topic records as they are stored: the envelope's columns, key and value as text."""
    return bronze_records(topic_records(s, d)).drop("bronze_ingestion_timestamp")


# Lifecycles ------------------------------------------------------------------------------------

@query
def lifecycle_states(s, d):
    return lifecycle.lifecycle_state(state_events(s, d))


@query
def merged_lifecycles(s, d):
    """Micro-batches merged column by column; here each batch holds one recording step."""
    batches = lifecycle.lifecycle_state(visit_events(s, d).withColumn("batch_id", F.col("seq")), "batch_id")
    return lifecycle.merge_states(batches)


@query
def finished_lifecycles(s, d):
    return lifecycle.finished(lifecycle.lifecycle_state(state_events(s, d))).select(
        "patient_id", "lab_id", "arrival_time", "service_start_time", "departure_time")


@query
def patient_metrics(s, d):
    return metrics(s, d)


@query
def recorded_journeys(s, d):
    return lifecycle.recorded_journeys(visit_events(s, d), "seq")


@query
def wait_pair_summary(s, d):
    return lifecycle.wait_summary(lifecycle.wait_pairs(visit_events(s, d), "seq"))


# Windows and summaries ---------------------------------------------------------------------------

@query
def operational_metrics(s, d):
    return operational(s, d)


@query
def floor_index_scorecard(s, d):
    """Exact P95 by floor index, mean, maximum and SLA share of all waits of a lab."""
    return wait_scorecard(metrics(s, d), ["lab_id"], "queue_wait_minutes", P.queue_sla_minutes, P.target_sla_percentage)


@query
def lab_summary(s, d):
    return windows.lab_summary(metrics(s, d), 720.0, 4)


@query
def sla_summary(s, d):
    return windows.sla_summary(metrics(s, d), P)


@query
def hourly_windows(s, d):
    return windows.window_metrics(metrics(s, d), P, 60)


@query
def table_bounds(s, d):
    return windows.bounds(metrics(s, d))


@query
def journey_summary(s, d):
    return windows.journey_summary(metrics(s, d))


@query
def rolled_up_totals(s, d):
    return windows.rolled_up(operational(s, d))


@query
def event_type_counts(s, d):
    return windows.counts_by(visit_events(s, d), "event_type")


@query
def patient_type_shares(s, d):
    return windows.shares_by(visits(s, d), "patient_type")


@query
def priority_shares(s, d):
    return windows.shares_by(visits(s, d), "priority")


@query
def arrivals_by_hour(s, d):
    return windows.arrivals_by_hour(visits(s, d))


@query
def distinct_patients(s, d):
    return windows.distinct_patients(visit_events(s, d))


# Queue state -----------------------------------------------------------------------------------

@query
def queue_snapshots(s, d):
    return snapshots(s, d)


@query
def queue_snapshots_half_hourly(s, d):
    return grid.queue_snapshots(metrics(s, d), Params(window_minutes=30, segment_minutes=30, staff_count=4))


@query
def queue_snapshots_all_labs(s, d):
    """Snapshots over the whole table without a lab key, anchored at the first arrival's minute."""
    return grid.queue_snapshots(metrics(s, d), P, keys=(), align="minute")


@query
def operational_state(s, d):
    return state(s, d)


@query
def staffing_decisions(s, d):
    return decisions(s, d)


@query
def severity_counts(s, d):
    return windows.counts_by(decisions(s, d), "severity", "additional_staff")


@query
def windows_needing_attention(s, d):
    return state(s, d).filter(F.col("operational_status") != "GREEN").select(
        "window_start", "lab_id", "patients_waiting", "queue_pressure", "operational_status")


@query
def interventions_required(s, d):
    return decisions(s, d).filter("intervention_required").select(
        "timestamp", "lab_id", "severity", "additional_staff", "reason")


@query
def most_congested_windows(s, d):
    """Top 20 windows by customers waiting."""
    rows = state(s, d).withColumn("order_key", -F.col("patients_waiting"))
    return head(rows, 20, "order_key", "window_start", "lab_id").select(
        "window_start", "lab_id", "patients_waiting", "operational_status")


@query
def waiting_at_windows(s, d):
    return grid.waiting_at(metrics(s, d), P)


@query
def in_service_at_windows(s, d):
    return grid.serving_at(metrics(s, d), P)


@query
def arrivals_after_windows(s, d):
    return grid.arriving_after(metrics(s, d), P)


@query
def history_before_windows(s, d):
    return grid.arrived_before(metrics(s, d), P)


# Forecasts -------------------------------------------------------------------------------------

@query
def arrival_counts_around(s, d):
    spans = {f"last_{m}": (-m, 0) for m in (30, 60, 90, 120)}
    return forecast.arrivals_around(*arrivals(s, d), {**spans, "next_30": (0, 30)}, P)


@query
def strategy_forecasts(s, d):
    return forecast.strategy_forecasts(*arrivals(s, d), P)


@query
def strategy_errors(s, d):
    return forecast.compare_strategies(*arrivals(s, d), P)


@query
def best_strategy(s, d):
    return forecast.best_forecast(forecast.compare_strategies(*arrivals(s, d), P), "strategy")


@query
def lookback_errors(s, d):
    return forecast.compare_lookbacks(*arrivals(s, d), P)


@query
def best_lookback(s, d):
    return forecast.best_forecast(forecast.compare_lookbacks(*arrivals(s, d), P), "lookback_minutes")


@query
def timeline_positions(s, d):
    return indexed(arrivals(s, d)[0])


@query
def weighted_demand_profile(s, d):
    cells, _ = arrivals(s, d)
    return forecast.demand_profile(cells, indexed(cells), P)


@query
def recent_demand_profile(s, d):
    cells, _ = arrivals(s, d)
    return forecast.demand_profile(cells, indexed(cells), P, weighted=False)


@query
def weighted_record_profile(s, d):
    """The joint history of patient type and service time before each window, with weights by segment."""
    m = metrics(s, d)
    return forecast.weighted_records(m, points(s, d), P)


def instants(s, d):
    """Moments off the grid: when a visit with an error event came, to the microsecond."""
    e = s.read.parquet(f"{d}/events.parquet").where("event_type = 'error'")
    return e.select(F.when(F.col("user_id") % 2 == 0, "LAB_A").otherwise("LAB_B").alias("lab_id"), F.col("ts").cast("timestamp_ntz").alias("timestamp"))


@query
def queue_at_instants(s, d):
    return grid.queue_at(metrics(s, d), instants(s, d))


@query
def episode_at_instants(s, d):
    """Who waits, is served and will arrive within the lookahead at each moment, and how long they have waited or have to go."""
    return grid.episode_at(metrics(s, d), instants(s, d), P)


@query
def rolled_up_p95(s, d):
    """P95 of the queue wait per hour and day, from sketches of the five-minute windows."""
    sketches = stage(windows.wait_sketches(metrics(s, d), P))
    each = [windows.rolled_up_percentile(sketches, length).withColumn("length", F.lit(length)) for length in ("1 hour", "1 day")]
    return each[0].unionByName(each[1])


# Counterfactual replays ------------------------------------------------------------------------

@query
def staffing_scenarios(s, d):
    """Scorecard of every window and extra staff."""
    return counterfactual.sweep_rows(replay.staffing_sweep(metrics(s, d), points(s, d), P), P)


@query
def recoverability(s, d):
    load = replay.window_load(metrics(s, d), points(s, d), P)
    r = counterfactual.recoverability(F.col("already_breached"), F.col("initial_waiting"), F.col("future_arrivals"), P)
    return load.select("lab_id", "window_start", r.alias("r")).select("lab_id", "window_start", "r.*")


@query
def recommendations(s, d):
    best = counterfactual.recommend(replay.staffing_sweep(metrics(s, d), points(s, d), P), P)
    return best.select("lab_id", "window_start", "decision", "objective", "reason", "chosen.*",
                       "sla_improvement_percentage_points", "p95_improvement_minutes")


@query
def scenario_report(s, d):
    """All scenarios of every window with the recommended one marked."""
    return counterfactual.scenario_report(metrics(s, d), points(s, d), P)


@query
def full_timeline_backtest(s, d):
    return full(s, d)


@query
def intervention_backtest(s, d):
    return backtest(s, d)


@query
def backtest_comparison_counts(s, d):
    return windows.counts_by(backtest(s, d), "comparison", "counterfactual_decision", "objective")


@query
def backtest_staffing_totals(s, d):
    return counterfactual.staffing_totals(backtest(s, d))


# Policies ----------------------------------------------------------------------------------------

@query
def policy_timeline(s, d):
    return policies(s, d)


@query
def policy_action_counts(s, d):
    return windows.counts_by(policies(s, d), "policy", "policy_action")


@query
def policy_resources(s, d):
    return policy.resource_use(policies(s, d), P)


@query
def policy_savings(s, d):
    return policy.policy_delta(policy.resource_use(policies(s, d), P), "STATIC_RULE", "COUNTERFACTUAL")


@query
def staffing_change_counts(s, d):
    return policy.change_counts(policies(s, d))


@query
def active_staff_windows(s, d):
    return policies(s, d).filter(F.col("active_additional_staff") > 0).select(
        "policy", "lab_id", "timestamp", "active_additional_staff", "policy_action")


# Queueing theory -----------------------------------------------------------------------------------

@query
def mmc_by_window(s, d):
    """Steady-state M/M/2 results for each half hour's arrival rate at the lab's service rate."""
    w = half_hours(s, d).join(comparison.service_rate(metrics(s, d)), "lab_id")
    hours = (micros("window_end") - micros("window_start")) / F.lit(3.6e9)
    return w.select("lab_id", "window_start", mmc(F.col("arrivals") / hours, F.col("service_rate_per_hour"),
                                                  F.lit(2)).alias("m")).select("lab_id", "window_start", "m.*")


@query
def lab_service_rates(s, d):
    return comparison.service_rate(metrics(s, d))


@query
def window_service_rates(s, d):
    return comparison.window_service_rate(half_hours(s, d)).select("lab_id", "window_start", "service_rate_per_hour")


@query
def theory_comparison(s, d):
    return comparison.compare(half_hours(s, d), 2, metrics(s, d))


@query
def theory_comparison_local(s, d):
    return comparison.compare(half_hours(s, d), 2)


@query
def theory_validation(s, d):
    return comparison.validation_summary(comparison.compare(half_hours(s, d), 2))


# Gold tables: one chain from recorded events ---------------------------------------------------------

def chain(s, d):
    return gold.tables(state_events(s, d), P)


@query
def gold_patient_metrics(s, d):
    return chain(s, d)["patient_metrics"]


@query
def gold_operational_metrics(s, d):
    return chain(s, d)["operational_metrics"]


@query
def gold_queue_metrics(s, d):
    return chain(s, d)["queue_metrics"]


@query
def gold_operational_state(s, d):
    return chain(s, d)["operational_state"]


@query
def gold_staffing_decisions(s, d):
    return chain(s, d)["staffing_decisions"]


@query
def gold_refreshed(s, d):
    """The last of the five tables, read back from one committed version of all of them."""
    root = workspace(s)
    discard_later(s, root)
    gold.refresh_tables(s, lifecycle.lifecycle_state(state_events(s, d)), root, P)
    return gold.tables_of(s, root, versions.note(s, root, versions.latest(s, root)))["staffing_decisions"]


# Streams -------------------------------------------------------------------------------------------

@query
def streamed_window_counts(s, d):
    """The window counts as an append-mode stream: windows behind the watermark only."""
    return streams.window_counts(s, d, P)


@query
def streamed_bronze(s, d):
    """Published records read back from the segments of a topic, in two runs of the stream."""
    return streams.bronze(s, d, topic_records(s, d))


@query
def streamed_batch_counts(s, d):
    """What each micro-batch of the silver stream has read, rejected, found late or repeated, dropped and stored."""
    return streams.batch_counts(s, d, P)


@query
def streamed_silver_events(s, d):
    """Validation, lag and de-duplication as a stream."""
    return streams.silver_events(s, d, P)


@query
def streamed_lifecycles(s, d):
    """Per-batch lifecycle upserts read back as one merged table."""
    return streams.lifecycles(s, d, P)


@query
def streamed_hold_policy(s, d):
    """The hold policy as a stateful stream over the rule's recommendations."""
    return streams.hold_policy(s, d, decisions(s, d), P)
