"""DuckDB statements that state what each catalog query must return.

They are written independently of the Spark plans: range joins instead of cell arithmetic,
and recursive statements instead of replays.
"""

from __future__ import annotations

SERVERS = 1          # baseline stations of the catalog's parameters
LEVELS = 6           # extra staff tried
HOLD = "INTERVAL 15 MINUTE"


def r(expr: str, name: str | None = None) -> str:
    """Round to 6 digits without a negative zero."""
    text = f"(round({expr}, 6) + 0.0)"
    return f"{text} AS {name}" if name else text


def minutes(start: str, end: str) -> str:
    return f"(epoch_us({end}) - epoch_us({start})) / 60000000.0::DOUBLE"


def severity(prefix: str = "") -> str:
    w, c, p, u = (f"{prefix}{x}" for x in ("patients_waiting", "sla_compliance_rate", "p95_queue_wait_minutes",
                                          "utilization_percentage"))
    return (f"CASE WHEN {w} >= 8 OR {c} < 80 OR {p} >= 20 THEN 'CRITICAL' WHEN {w} >= 4 OR {p} >= 10 THEN 'HIGH' "
            f"WHEN {u} >= 100 AND {w} > 0 THEN 'WATCH' ELSE 'NORMAL' END")


CTES: dict[str, str] = {}

CTES["lc"] = """
SELECT 'P' || event_id AS patient_id, event_id AS num,
       CASE WHEN user_id % 2 = 0 THEN 'LAB_A' ELSE 'LAB_B' END AS lab_id,
       CASE user_id % 4 WHEN 0 THEN 'OUTPATIENT' WHEN 1 THEN 'INPATIENT' WHEN 2 THEN 'WALK_IN' ELSE 'FOLLOW_UP' END AS patient_type,
       CASE event_id % 4 WHEN 0 THEN 'NORMAL' WHEN 1 THEN 'URGENT' WHEN 2 THEN 'PEDIATRIC' ELSE 'ELDERLY' END AS priority,
       'STAFF_0' || (event_id % 4 + 1) AS staff_id,
       date_trunc('second', ts) AS arrival_time,
       date_trunc('second', ts) + INTERVAL 2 MINUTE AS registration_completed_time,
       date_trunc('second', ts) + INTERVAL 2 MINUTE AS queue_entry_time,
       date_trunc('second', ts) + INTERVAL 2 MINUTE + (CAST(floor(value) AS INT) % 25) * INTERVAL 1 MINUTE AS service_start_time,
       date_trunc('second', ts) + INTERVAL 2 MINUTE + (CAST(floor(value) AS INT) % 25) * INTERVAL 1 MINUTE
           + (3 + event_id % 7) * INTERVAL 1 MINUTE AS service_end_time
FROM events"""

CTES["pm"] = f"""
SELECT patient_id, lab_id, patient_type, priority, staff_id, arrival_time, registration_completed_time,
       queue_entry_time, service_start_time, service_end_time, service_end_time AS departure_time,
       {minutes('arrival_time', 'registration_completed_time')} AS registration_minutes,
       {minutes('queue_entry_time', 'service_start_time')} AS queue_wait_minutes,
       {minutes('service_start_time', 'service_end_time')} AS service_minutes,
       {minutes('arrival_time', 'service_end_time')} AS total_journey_minutes,
       service_start_time > queue_entry_time AS waited,
       service_start_time > queue_entry_time + INTERVAL 15 MINUTE AS sla_breached
FROM lc"""

CTES["ev"] = """
SELECT patient_id || '_' || k.event_type AS event_id, k.event_type, patient_id, num, lab_id, k.event_time,
       patient_type, priority, staff_id, k.seq
FROM lc, (VALUES (0, 'PATIENT_ARRIVAL'), (1, 'REGISTRATION_COMPLETED'), (2, 'QUEUE_ENTERED'), (3, 'SERVICE_STARTED'),
                 (4, 'SERVICE_COMPLETED'), (5, 'PATIENT_DEPARTED'), (6, 'PATIENT_ARRIVAL')) s(seq, event_type),
     LATERAL (SELECT s.seq AS seq, s.event_type AS event_type, CASE s.seq WHEN 0 THEN arrival_time
         WHEN 1 THEN registration_completed_time WHEN 2 THEN queue_entry_time WHEN 3 THEN service_start_time
         WHEN 4 THEN service_end_time WHEN 5 THEN service_end_time ELSE arrival_time + INTERVAL 2 MINUTE END AS event_time) k
WHERE s.seq < 6 OR num % 7 = 0"""

CTES["rec"] = """
SELECT *, CASE WHEN event_type = 'SERVICE_STARTED' THEN num % 11 ELSE 0 END AS fault,
       (num % 4)::INT AS "partition", num * 8 + seq AS "offset",
       event_time + (num % 13) * INTERVAL 1 MINUTE AS ingested, (num % 13) * 60 AS lag
FROM ev"""

CTES["rejected"] = """
SELECT 'visits' AS topic, "partition", "offset", event_id AS event_key,
       CASE fault WHEN 1 THEN 'MALFORMED_JSON' WHEN 2 THEN 'MISSING_EVENT_ID' WHEN 3 THEN 'MISSING_PATIENT_ID'
            WHEN 4 THEN 'MISSING_LAB_ID' WHEN 5 THEN 'MISSING_EVENT_TIME' ELSE 'MISSING_EVENT_TYPE' END AS quarantine_reason
FROM rec WHERE fault BETWEEN 1 AND 6"""

CTES["ok"] = """SELECT *, lag > 300 AS is_late FROM rec WHERE fault NOT BETWEEN 1 AND 6"""

CTES["silver"] = """
SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ingested, "partition", "offset") = 1"""

CTES["states"] = """
SELECT patient_id, lab_id, max(event_time) FILTER (event_type = 'PATIENT_ARRIVAL') AS arrival_time,
       max(event_time) FILTER (event_type = 'REGISTRATION_COMPLETED') AS registration_completed_time,
       max(event_time) FILTER (event_type = 'QUEUE_ENTERED') AS queue_entry_time,
       max(event_time) FILTER (event_type = 'SERVICE_STARTED') AS service_start_time,
       max(event_time) FILTER (event_type = 'SERVICE_COMPLETED') AS service_end_time,
       max(event_time) FILTER (event_type = 'PATIENT_DEPARTED') AS departure_time,
       max(patient_type) AS patient_type, max(priority) AS priority, max(staff_id) AS staff_id
FROM silver GROUP BY 1, 2"""

CTES["om"] = """
SELECT time_bucket(INTERVAL 5 MINUTE, arrival_time) AS window_start,
       time_bucket(INTERVAL 5 MINUTE, arrival_time) + INTERVAL 5 MINUTE AS window_end, lab_id,
       count(*) AS patients_arrived, count(*) FILTER (waited) AS patients_who_waited,
       avg(queue_wait_minutes) AS avg_queue_wait_minutes, quantile_disc(queue_wait_minutes, 0.95) AS p95_queue_wait_minutes,
       max(queue_wait_minutes) AS max_queue_wait_minutes, avg(registration_minutes) AS avg_registration_minutes,
       avg(service_minutes) AS avg_service_minutes, avg(total_journey_minutes) AS avg_total_journey_minutes,
       count(*) FILTER (sla_breached) AS sla_breaches,
       count(*) FILTER (sla_breached) / count(*) * 100 AS sla_breach_rate,
       100 - count(*) FILTER (sla_breached) / count(*) * 100 AS sla_compliance_rate
FROM pm GROUP BY 1, 2, 3"""


def grid(step: int, staff: int, lab: bool = True, anchor: str | None = None) -> str:
    start = anchor or f"time_bucket(INTERVAL {step} MINUTE, min(arrival_time))"
    key, on, by = ("lab_id,", "p.lab_id = g.lab_id AND", "lab_id") if lab else ("", "", "1")
    group = "GROUP BY lab_id" if lab else ""
    sel = "g.lab_id," if lab else ""
    return f"""
WITH g AS (SELECT {key} unnest(generate_series({start}, max(departure_time), INTERVAL {step} MINUTE)) AS t FROM pm {group}),
w AS (SELECT {sel} g.t, count(p.patient_id) AS n FROM g LEFT JOIN pm p ON {on} p.queue_entry_time <= g.t AND p.service_start_time > g.t GROUP BY ALL),
s AS (SELECT {sel} g.t, count(p.patient_id) AS n FROM g LEFT JOIN pm p ON {on} p.service_start_time <= g.t AND p.service_end_time > g.t GROUP BY ALL)
SELECT {"w.lab_id," if lab else ""} w.t AS timestamp, w.n AS patients_waiting, s.n AS patients_in_service,
       {r(f"s.n / {staff}.0::DOUBLE * 100", "utilization_percentage")}
FROM w JOIN s ON {"w.lab_id = s.lab_id AND" if lab else ""} w.t = s.t"""


CTES["qs"] = grid(5, SERVERS)

CTES["st"] = """
SELECT om.*, coalesce(q.patients_waiting, 0) AS patients_waiting, coalesce(q.patients_in_service, 0) AS patients_in_service,
       coalesce(q.utilization_percentage, 0.0) AS utilization_percentage,
       CASE WHEN coalesce(q.patients_waiting, 0) = 0 THEN 'NONE' WHEN q.patients_waiting <= 3 THEN 'LOW'
            WHEN q.patients_waiting <= 7 THEN 'MODERATE' ELSE 'HIGH' END AS queue_pressure,
       CASE WHEN coalesce(q.patients_waiting, 0) >= 8 OR sla_compliance_rate < 80 THEN 'RED'
            WHEN coalesce(q.patients_waiting, 0) >= 4 OR coalesce(q.utilization_percentage, 0) >= 100 OR sla_compliance_rate < 95 THEN 'AMBER'
            ELSE 'GREEN' END AS operational_status
FROM om LEFT JOIN qs q ON om.lab_id = q.lab_id AND om.window_start = q.timestamp"""

CTES["dec"] = f"""
SELECT window_start AS timestamp, lab_id, patients_waiting, patients_in_service, utilization_percentage,
       avg_queue_wait_minutes AS average_wait_minutes, p95_queue_wait_minutes AS p95_wait_minutes, sla_compliance_rate,
       sev <> 'NORMAL' AS intervention_required, sev AS severity,
       CASE sev WHEN 'CRITICAL' THEN 2 WHEN 'HIGH' THEN 1 WHEN 'WATCH' THEN 1 ELSE 0 END AS additional_staff,
       CASE sev WHEN 'CRITICAL' THEN 'Severe queue congestion detected. Deploy two additional staff.'
                WHEN 'HIGH' THEN 'Queue pressure is increasing. Deploy one additional staff member.'
                WHEN 'WATCH' THEN 'All service capacity is occupied while patients are waiting.'
                ELSE 'No staffing intervention required.' END AS reason
FROM (SELECT *, {severity()} AS sev FROM st)"""

CTES["tl"] = "SELECT lab_id, window_start AS t FROM om"

CTES["edge"] = "SELECT lab_id, min(arrival_time) AS first_a, max(arrival_time) AS last_a, max(departure_time) AS last_d FROM pm GROUP BY 1"


def span(name: str, start: int, stop: int) -> str:
    return f"""
SELECT tl.lab_id, tl.t, count(pm.patient_id) AS n FROM tl LEFT JOIN pm ON pm.lab_id = tl.lab_id
  AND pm.arrival_time >= tl.t + {start} * INTERVAL 1 MINUTE AND pm.arrival_time < tl.t + {stop} * INTERVAL 1 MINUTE
GROUP BY 1, 2"""


for _m in (30, 60, 90, 120):
    CTES[f"last_{_m}"] = span(f"last_{_m}", -_m, 0)
CTES["older"], CTES["recent"], CTES["next_30"] = span("older", -30, -15), span("recent", -15, 0), span("next_30", 0, 30)

CTES["pred"] = """
SELECT o.lab_id, o.t AS window_start, o.n AS older, c.n AS recent, a.n AS actual,
       (o.n + c.n) / 30.0::DOUBLE * 30 AS rolling_rate,
       (o.n / 15.0::DOUBLE * 1.0 + c.n / 15.0::DOUBLE * 2.0) / 3.0::DOUBLE * 30 AS weighted_recent,
       greatest(0.0::DOUBLE, c.n / 15.0::DOUBLE + 0.5::DOUBLE * (c.n / 15.0::DOUBLE - o.n / 15.0::DOUBLE)) * 30 AS trend_adjusted
FROM older o JOIN recent c USING (lab_id, t) JOIN next_30 a USING (lab_id, t) JOIN edge USING (lab_id)
WHERE o.t - INTERVAL 30 MINUTE >= first_a AND o.t + INTERVAL 30 MINUTE <= last_a"""


def errors(key: str, source: str) -> str:
    return f"""
SELECT {key}, count(*) AS observations, {r('avg(abs(predicted - actual))', 'mae')}, {r('avg(predicted - actual)', 'bias')},
       {r('sqrt(avg((predicted - actual) ** 2))', 'rmse')},
       {r('avg(abs(predicted - actual) / actual) FILTER (actual > 0) * 100', 'mape')}
FROM {source} GROUP BY 1"""


CTES["strat"] = errors("strategy", """(
    SELECT 'ROLLING_RATE' AS strategy, actual, rolling_rate AS predicted FROM pred UNION ALL
    SELECT 'WEIGHTED_RECENT', actual, weighted_recent FROM pred UNION ALL
    SELECT 'TREND_ADJUSTED', actual, trend_adjusted FROM pred)""")

CTES["look"] = errors("lookback_minutes", "(" + " UNION ALL ".join(f"""
    SELECT {m}::INT AS lookback_minutes, a.n AS actual, l.n / {m}.0::DOUBLE * 30 AS predicted
    FROM last_{m} l JOIN next_30 a USING (lab_id, t) JOIN edge USING (lab_id)
    WHERE l.t - INTERVAL {m} MINUTE >= first_a AND l.t + INTERVAL 30 MINUTE <= last_a""" for m in (30, 60, 90, 120)) + ")")

CTES["idx"] = "SELECT lab_id, t, row_number() OVER (PARTITION BY lab_id ORDER BY t) AS timeline_index FROM tl"

# Replays: numbered jobs per window, then one recursion step per job.
CTES["jobs"] = f"""
SELECT *, row_number() OVER (PARTITION BY lab_id, t ORDER BY phase, ord, pid) AS k FROM (
    SELECT tl.lab_id, tl.t, 0 AS phase, service_start_time AS ord, patient_id AS pid, 0.0::DOUBLE AS a,
           {minutes('tl.t', 'service_end_time')} AS s, NULL::DOUBLE AS w
    FROM tl JOIN pm ON tl.lab_id = pm.lab_id AND service_start_time <= tl.t AND service_end_time > tl.t
    UNION ALL
    SELECT tl.lab_id, tl.t, 1, queue_entry_time, patient_id, 0.0, service_minutes, {minutes('queue_entry_time', 'tl.t')}
    FROM tl JOIN pm ON tl.lab_id = pm.lab_id AND queue_entry_time <= tl.t AND service_start_time > tl.t
    UNION ALL
    SELECT tl.lab_id, tl.t, 2, arrival_time, patient_id, {minutes('tl.t', 'arrival_time')}, service_minutes, 0.0
    FROM tl JOIN pm ON tl.lab_id = pm.lab_id AND arrival_time >= tl.t AND arrival_time < tl.t + INTERVAL 30 MINUTE)"""

CTES["fold"] = f"""
SELECT lab_id, t, x, 0::BIGINT AS k, list_resize([]::DOUBLE[], {SERVERS} + x, 0.0::DOUBLE) AS free, NULL::DOUBLE AS wait
FROM tl, range(0, {LEVELS} + 1) lv(x)
UNION ALL
SELECT f.lab_id, f.t, f.x, j.k, list_sort(list_append(f.free[2:], greatest(f.free[1], j.a) + j.s)),
       greatest(f.free[1], j.a) - j.a + j.w
FROM fold f JOIN jobs j ON f.lab_id = j.lab_id AND f.t = j.t AND j.k = f.k + 1"""

CTES["card"] = """
SELECT lab_id, t, x, count(wait) AS n, avg(wait) AS average_wait_minutes, max(wait) AS max_wait_minutes,
       list_sort(list(wait) FILTER (wait IS NOT NULL))[1 + floor(0.95::DOUBLE * (count(wait) - 1))::BIGINT] AS p95_wait_minutes,
       count(*) FILTER (wait <= 15) / count(wait) * 100 AS sla_percentage
FROM fold GROUP BY 1, 2, 3"""

CTES["info"] = """
SELECT lab_id, t, count(*) FILTER (phase = 1)::INT AS initial_waiting, count(*) FILTER (phase = 0)::INT AS initial_in_service,
       count(*) FILTER (phase = 2)::INT AS future_arrivals, count(*) FILTER (phase = 1 AND w > 15)::INT AS breached,
       (count(*) FILTER (phase > 0) - count(*) FILTER (phase = 1 AND w > 15)) / count(*) FILTER (phase > 0) * 100 AS best
FROM jobs GROUP BY 1, 2"""

# Damage control: walk the levels upwards from the selected one.
CTES["walk"] = f"""
SELECT lab_id, t, 0 AS x, 0 AS pick, sla_percentage AS sla, p95_wait_minutes AS p95 FROM card WHERE x = 0
UNION ALL
SELECT w.lab_id, w.t, w.x + 1, CASE WHEN b THEN c.x ELSE w.pick END, CASE WHEN b THEN c.sla_percentage ELSE w.sla END,
       CASE WHEN b THEN c.p95_wait_minutes ELSE w.p95 END
FROM walk w JOIN card c ON c.lab_id = w.lab_id AND c.t = w.t AND c.x = w.x + 1,
     LATERAL (SELECT c.sla_percentage - w.sla > 1e-9 OR (abs(c.sla_percentage - w.sla) <= 1e-9 AND w.p95 - c.p95_wait_minutes >= 2.0) AS b)"""

CTES["pick"] = f"""
SELECT i.*, CASE WHEN best < 95 THEN 'DAMAGE_CONTROL' WHEN f.x IS NULL THEN 'SEARCH_LIMIT_REACHED'
                 WHEN f.x = 0 THEN 'NO_ACTION_REQUIRED' ELSE 'STAFFING_INTERVENTION' END AS decision,
       CASE WHEN best < 95 THEN 'RESOURCE_AWARE_DAMAGE_CONTROL' WHEN f.x IS NULL THEN 'BEST_EFFORT' ELSE 'SLA_RESTORATION' END AS objective,
       CASE WHEN best < 95 OR f.x IS NULL THEN w.pick ELSE f.x END AS x
FROM info i JOIN walk w ON i.lab_id = w.lab_id AND i.t = w.t AND w.x = {LEVELS}
LEFT JOIN (SELECT lab_id, t, min(x) AS x FROM card WHERE sla_percentage >= 95 GROUP BY 1, 2) f ON f.lab_id = i.lab_id AND f.t = i.t"""

CTES["ft"] = f"""
SELECT p.t AS timestamp, p.lab_id, d.severity AS rule_severity, d.additional_staff AS rule_additional_staff,
       p.decision AS counterfactual_decision, p.objective, p.x::INT AS model_additional_staff, ({SERVERS} + p.x)::INT AS model_total_staff,
       p.initial_waiting, p.initial_in_service, p.future_arrivals,
       {r('b.sla_percentage', 'baseline_predicted_sla')}, {r('b.p95_wait_minutes', 'baseline_predicted_p95_wait')},
       {r('c.sla_percentage', 'recommended_predicted_sla')}, {r('c.p95_wait_minutes', 'recommended_predicted_p95_wait')},
       {r('p.best', 'maximum_possible_sla_percentage')}, p.breached AS already_breached_patients,
       {r('c.sla_percentage - b.sla_percentage', 'sla_improvement_percentage_points')},
       {r('b.p95_wait_minutes - c.p95_wait_minutes', 'p95_improvement_minutes')}
FROM pick p JOIN card b ON b.lab_id = p.lab_id AND b.t = p.t AND b.x = 0
JOIN card c ON c.lab_id = p.lab_id AND c.t = p.t AND c.x = p.x
JOIN dec d ON d.lab_id = p.lab_id AND d.timestamp = p.t"""

CTES["bt"] = f"""
SELECT f.timestamp, f.lab_id, f.rule_severity, f.rule_additional_staff, f.counterfactual_decision, f.objective,
       f.model_additional_staff, f.model_total_staff,
       CASE WHEN f.counterfactual_decision IN ('DAMAGE_CONTROL', 'SEARCH_LIMIT_REACHED') THEN f.counterfactual_decision
            WHEN rule_additional_staff > model_additional_staff THEN 'RULE_OVERSTAFFS'
            WHEN rule_additional_staff < model_additional_staff THEN 'RULE_UNDERSTAFFS' ELSE 'ALIGNED' END AS comparison,
       f.initial_waiting, f.initial_in_service, f.future_arrivals, f.baseline_predicted_sla, f.baseline_predicted_p95_wait,
       {r('b.average_wait_minutes', 'baseline_predicted_avg_wait')}, {r('b.max_wait_minutes', 'baseline_predicted_max_wait')},
       f.recommended_predicted_sla, f.recommended_predicted_p95_wait,
       {r('c.average_wait_minutes', 'recommended_predicted_avg_wait')}, {r('c.max_wait_minutes', 'recommended_predicted_max_wait')},
       f.maximum_possible_sla_percentage, f.already_breached_patients, f.sla_improvement_percentage_points, f.p95_improvement_minutes
FROM ft f JOIN card b ON b.lab_id = f.lab_id AND b.t = f.timestamp AND b.x = 0
JOIN card c ON c.lab_id = f.lab_id AND c.t = f.timestamp AND c.x = f.model_additional_staff
WHERE f.rule_severity <> 'NORMAL'"""

CTES["steps"] = """
SELECT *, row_number() OVER (PARTITION BY policy, lab_id ORDER BY timestamp) AS k FROM (
    SELECT 'STATIC_RULE' AS policy, rule_additional_staff::INT AS ask, * FROM ft UNION ALL
    SELECT 'COUNTERFACTUAL', model_additional_staff::INT, * FROM ft)"""

CTES["held"] = f"""
SELECT policy, lab_id, 0::BIGINT AS k, NULL::TIMESTAMP AS timestamp, 0 AS active, NULL::TIMESTAMP AS until, 0 AS change, '' AS act
FROM (SELECT DISTINCT policy, lab_id FROM steps)
UNION ALL
SELECT h.policy, h.lab_id, s.k, s.timestamp, z.now,
       CASE z.act WHEN 'RELEASE' THEN NULL WHEN 'DEPLOY' THEN s.timestamp + {HOLD} WHEN 'ESCALATE' THEN s.timestamp + {HOLD}
                  WHEN 'DEESCALATE' THEN s.timestamp + {HOLD} ELSE h.until END,
       z.now - h.active, z.act
FROM held h JOIN steps s ON s.policy = h.policy AND s.lab_id = h.lab_id AND s.k = h.k + 1,
LATERAL (SELECT CASE WHEN h.active = 0 AND s.ask = 0 THEN 'NO_ACTION' WHEN h.active = 0 THEN 'DEPLOY' WHEN s.ask > h.active THEN 'ESCALATE'
                     WHEN s.ask = h.active OR s.timestamp < h.until THEN 'HOLD' WHEN s.ask = 0 THEN 'RELEASE' ELSE 'DEESCALATE' END AS act,
                CASE WHEN s.ask < h.active AND s.timestamp < h.until THEN h.active ELSE s.ask END AS now) z"""

CTES["pol"] = f"""
SELECT s.lab_id, s.timestamp, s.counterfactual_decision, s.objective, s.baseline_predicted_sla, s.recommended_predicted_sla,
       s.policy, s.ask AS instantaneous_recommendation, h.change AS staff_change, h.active AS active_additional_staff,
       h.act AS policy_action,
       CASE h.act WHEN 'NO_ACTION' THEN 'No additional staffing required.' WHEN 'DEPLOY' THEN 'Additional capacity deployed.'
            WHEN 'ESCALATE' THEN 'Additional capacity increased because the required staffing level rose.'
            WHEN 'RELEASE' THEN 'Additional capacity released after the hold period.'
            WHEN 'DEESCALATE' THEN 'Additional capacity reduced after the hold period.'
            ELSE CASE WHEN s.ask = h.active THEN 'Current staffing intervention remains appropriate.'
                      ELSE 'Minimum intervention hold period has not yet elapsed.' END END AS reason
FROM steps s JOIN held h ON s.policy = h.policy AND s.lab_id = h.lab_id AND s.k = h.k"""

CTES["res"] = f"""
SELECT policy, count(*) AS windows, sum(active_additional_staff)::BIGINT AS staff_window_units,
       {r('avg(active_additional_staff)', 'average_extra_staff')}, max(active_additional_staff) AS peak_extra_staff,
       count(*) FILTER (policy_action IN ('DEPLOY', 'ESCALATE', 'DEESCALATE', 'RELEASE')) AS change_actions,
       sum(active_additional_staff)::BIGINT * 5 AS staff_minutes, {r('sum(active_additional_staff) * 5 / 60.0::DOUBLE', 'staff_hours')},
       {r('sum(active_additional_staff) * 5 / 60.0::DOUBLE * 35.0::DOUBLE', 'cost')}
FROM pol GROUP BY 1"""


def fixed_windows(step: int, stations: int) -> str:
    return f"""
WITH b AS (SELECT lab_id, date_trunc('hour', first_a) AS s, last_d AS e FROM edge),
g AS (SELECT lab_id, s, e, unnest(generate_series(s, e - INTERVAL 1 MICROSECOND, INTERVAL {step} MINUTE)) AS w0 FROM b),
v AS (SELECT lab_id, w0, least(w0 + INTERVAL {step} MINUTE, e) AS w1 FROM g),
ar AS (SELECT v.lab_id, v.w0, count(*) AS n, avg(queue_wait_minutes) AS aw, max(queue_wait_minutes) AS mw,
              count(*) FILTER (queue_wait_minutes > 15) / count(*) AS br
       FROM v JOIN pm ON pm.lab_id = v.lab_id AND arrival_time >= w0 AND arrival_time < w1 GROUP BY 1, 2),
sv AS (SELECT v.lab_id, v.w0, count(*) AS n, avg(service_minutes) AS ms
       FROM v JOIN pm ON pm.lab_id = v.lab_id AND service_end_time >= w0 AND service_end_time < w1 GROUP BY 1, 2),
ov AS (SELECT v.lab_id, v.w0, sum({minutes('greatest(service_start_time, w0)', 'least(service_end_time, w1)')}) AS busy
       FROM v JOIN pm ON pm.lab_id = v.lab_id AND service_end_time > w0 AND service_start_time < w1 GROUP BY 1, 2)
SELECT v.lab_id, v.w0 AS window_start, v.w1 AS window_end, coalesce(ar.n, 0)::BIGINT AS arrivals, coalesce(sv.n, 0)::BIGINT AS patients_served,
       coalesce(ar.aw, 0) AS average_queue_wait_minutes, coalesce(ar.mw, 0) AS maximum_queue_wait_minutes,
       coalesce(sv.ms, 0) AS average_service_time_minutes, coalesce(ov.busy, 0) / ({step} * {stations})::DOUBLE AS utilization,
       coalesce(ar.br, 0)::DOUBLE AS sla_breach_rate
FROM v LEFT JOIN ar USING (lab_id, w0) LEFT JOIN sv USING (lab_id, w0) LEFT JOIN ov USING (lab_id, w0)"""


CTES["w60"], CTES["w30"] = fixed_windows(60, SERVERS), fixed_windows(30, SERVERS)
CTES["mu"] = "SELECT lab_id, 60.0::DOUBLE / avg(service_minutes) AS mu FROM pm GROUP BY 1"


def theory(local: bool) -> str:
    mu = ("CASE WHEN patients_served > 0 AND average_service_time_minutes > 0 THEN 60.0::DOUBLE / average_service_time_minutes END"
          if local else "mu.mu")
    zero_error = "0.0::DOUBLE" if local else "CASE WHEN seen = 0 THEN 0.0::DOUBLE END"
    return f"""
WITH x AS (SELECT w.*, arrivals / ({minutes('window_start', 'window_end')} / 60) AS lam, {mu} AS m, average_queue_wait_minutes AS seen
           FROM w30 w {"" if local else "JOIN mu ON mu.lab_id = w.lab_id"}),
y AS (SELECT *, lam / (2 * m) AS rho, lam / m AS a FROM x),
z AS (SELECT *, CASE WHEN rho < 1 AND lam > 0 THEN
        (a * a / 2 / (1 - rho)) / (1 + a + a * a / 2 / (1 - rho)) * rho / (1 - rho) / lam * 60 END AS wq FROM y)
SELECT lab_id, window_start, window_end,
       {r('CASE WHEN m IS NULL OR lam = 0 THEN 0 ELSE lam END', 'arrival_rate_per_hour')},
       {r('coalesce(m, 0)', 'service_rate_per_hour')}, 2 AS server_count,
       {r('CASE WHEN m IS NULL OR lam = 0 THEN 0 ELSE rho END', 'theoretical_utilization')},
       {r('CASE WHEN m IS NULL THEN NULL WHEN lam = 0 THEN 0 WHEN rho >= 1 THEN NULL ELSE wq END', 'theoretical_wait_minutes')},
       {r('seen', 'observed_wait_minutes')},
       {r('CASE WHEN m IS NULL THEN NULL WHEN lam = 0 THEN -seen WHEN rho >= 1 THEN NULL ELSE seen - wq END', 'wait_difference_minutes')},
       {r(f'CASE WHEN m IS NULL THEN NULL WHEN lam = 0 THEN {zero_error} WHEN rho >= 1 THEN NULL WHEN wq > 0 THEN (seen - wq) / wq END', 'relative_error')},
       m IS NULL OR lam = 0 OR rho < 1 AS system_stable
FROM z"""


CTES["cmp"], CTES["cmpl"] = theory(False), theory(True)

CTES["merged"] = """
SELECT patient_id, lab_id, arg_max(event_time, seq) FILTER (event_type = 'PATIENT_ARRIVAL') AS arrival_time,
       arg_max(event_time, seq) FILTER (event_type = 'REGISTRATION_COMPLETED') AS registration_completed_time,
       arg_max(event_time, seq) FILTER (event_type = 'QUEUE_ENTERED') AS queue_entry_time,
       arg_max(event_time, seq) FILTER (event_type = 'SERVICE_STARTED') AS service_start_time,
       arg_max(event_time, seq) FILTER (event_type = 'SERVICE_COMPLETED') AS service_end_time,
       arg_max(event_time, seq) FILTER (event_type = 'PATIENT_DEPARTED') AS departure_time,
       max(patient_type) AS patient_type, max(priority) AS priority, max(staff_id) AS staff_id
FROM ev GROUP BY 1, 2"""


def _words(text: str) -> set[str]:
    import re

    return set(re.findall(r"[a-z_][a-z0-9_]*", text))


MATERIALIZED = {"pm", "ev", "om", "qs", "st", "jobs", "card", "ft", "steps", "pol", "silver", "states", "walk"}


def _place(name: str, other: dict[str, str]) -> float:
    """Definition order; a part given anew comes after `states`, which it may read."""
    at = [*CTES].index(name)
    return [*CTES].index("states") + 0.5 if name in other else at


def statement(select: str, **other: str) -> str:
    """A full statement: the named parts it needs, in definition order, then the select. Parts may be given anew."""
    known = CTES | other
    order = sorted(known, key=lambda n: _place(n, other))
    needed: set[str] = set()
    todo = [select]
    while todo:
        for name in _words(todo.pop()) & set(known):
            if name not in needed:
                needed.add(name)
                todo.append(known[name])
    parts = [f"{n} AS {'MATERIALIZED ' if n in MATERIALIZED and n not in ('walk',) else ''}({known[n]})" for n in order if n in needed]
    return f"WITH RECURSIVE {', '.join(parts)} {select}" if parts else select


def rounded(source: str, plain: str, doubles: str) -> str:
    cols = [c.strip() for c in plain.split(",") if c.strip()]
    return f"SELECT {', '.join(cols + [r(c.strip(), c.strip()) for c in doubles.split(',')])} FROM {source}"


PM_DOUBLES = "registration_minutes, queue_wait_minutes, service_minutes, total_journey_minutes"
OM_PLAIN = "window_start, window_end, lab_id, patients_arrived, patients_who_waited, sla_breaches"
OM_DOUBLES = ("avg_queue_wait_minutes, p95_queue_wait_minutes, max_queue_wait_minutes, avg_registration_minutes, "
              "avg_service_minutes, avg_total_journey_minutes, sla_breach_rate, sla_compliance_rate")
DEC_DOUBLES = "utilization_percentage, average_wait_minutes, p95_wait_minutes, sla_compliance_rate"
WIN_DOUBLES = "average_queue_wait_minutes, maximum_queue_wait_minutes, average_service_time_minutes, utilization, sla_breach_rate"
STATE_COLS = ("patient_id, lab_id, arrival_time, registration_completed_time, queue_entry_time, service_start_time, "
              "service_end_time, departure_time, patient_type, priority, staff_id")
CARD = (f"lab_id, t AS window_start, ({SERVERS} + x)::INT AS staff_count, x::INT AS additional_staff, "
        f"{r('average_wait_minutes', 'average_wait_minutes')}, {r('p95_wait_minutes', 'p95_wait_minutes')}, "
        f"{r('max_wait_minutes', 'max_wait_minutes')}, {r('sla_percentage', 'sla_percentage')}, sla_percentage >= 95 AS meets_sla")
REASONS = """CASE decision WHEN 'DAMAGE_CONTROL' THEN 'The SLA target is no longer mathematically recoverable. The recommendation maximizes achievable SLA and adds further capacity only when the reduction in P95 waiting time is operationally meaningful.'
    WHEN 'SEARCH_LIMIT_REACHED' THEN 'The SLA is theoretically recoverable, but no tested staffing level restored it. The best resource-aware scenario within the configured search range was returned.'
    ELSE 'The minimum feasible staffing scenario capable of restoring the SLA was identified.' END AS reason"""

JSON = """to_json({'event_id': event_id, 'event_type': event_type, 'patient_id': patient_id, 'lab_id': lab_id,
    'priority': priority, 'appointment_id': NULL})::VARCHAR"""

SELECTS: dict[str, str] = {
    "quarantined_records": "SELECT * FROM rejected",
    "quarantine_counts": "SELECT quarantine_reason, count(*) AS n FROM rejected GROUP BY 1",
    "accepted_events": """SELECT event_id, event_type, patient_id, lab_id, event_time, patient_type, priority, staff_id, "offset",
        lag AS event_lag_seconds, is_late FROM ok""",
    "silver_events": """SELECT event_id, event_type, patient_id, lab_id, event_time, "offset", lag AS event_lag_seconds, is_late FROM silver""",
    "event_window_counts": f"""SELECT time_bucket(INTERVAL 5 MINUTE, event_time) AS window_start,
        time_bucket(INTERVAL 5 MINUTE, event_time) + INTERVAL 5 MINUTE AS window_end, lab_id,
        count(*) FILTER (event_type = 'PATIENT_ARRIVAL') AS arrivals, count(*) FILTER (event_type = 'SERVICE_STARTED') AS services_started,
        count(*) FILTER (event_type = 'SERVICE_COMPLETED') AS services_completed, count(*) FILTER (event_type = 'PATIENT_DEPARTED') AS departures,
        {r('avg(lag)', 'avg_event_lag_seconds')}, count(*) FILTER (is_late) AS late_event_count FROM silver GROUP BY 1, 2, 3""",
    "published_events": f"SELECT event_id AS key, {JSON} AS value FROM ev",
    "bronze_envelope": f"""SELECT 'visits' AS topic, (num % 4)::INT AS "partition", num AS "offset",
        make_timestamp(num * 1000000) AS kafka_timestamp, event_id AS event_key, {JSON} AS event_json FROM ev""",
    "lifecycle_states": f"SELECT {STATE_COLS} FROM states",
    "merged_lifecycles": f"SELECT {STATE_COLS} FROM merged",
    "finished_lifecycles": """SELECT patient_id, lab_id, arrival_time, service_start_time, departure_time FROM states
        WHERE arrival_time IS NOT NULL AND queue_entry_time IS NOT NULL AND service_start_time IS NOT NULL
          AND service_end_time IS NOT NULL AND departure_time IS NOT NULL""",
    "patient_metrics": rounded("pm", STATE_COLS + ", waited, sla_breached", PM_DOUBLES),
    "recorded_journeys": f"""SELECT patient_id, lab_id, arrival_time, registration_completed_time AS registration_time, queue_entry_time,
        service_start_time, service_end_time, departure_time, {r(minutes('arrival_time', 'registration_completed_time'), 'registration_duration_minutes')},
        {r(minutes('queue_entry_time', 'service_start_time'), 'queue_wait_minutes')},
        {r(minutes('service_start_time', 'service_end_time'), 'service_duration_minutes')},
        {r(minutes('arrival_time', 'departure_time'), 'total_journey_minutes')} FROM merged""",
    "wait_pair_summary": f"""SELECT count(*) AS patients, {r('avg(queue_wait_minutes)', 'average_wait_minutes')},
        {r('max(queue_wait_minutes)', 'maximum_wait_minutes')}, count(*) FILTER (queue_wait_minutes > 0) AS patients_who_waited FROM pm""",
    "operational_metrics": rounded("om", OM_PLAIN, OM_DOUBLES),
    "floor_index_scorecard": f"""SELECT lab_id, count(*) AS patients, {r('avg(queue_wait_minutes)', 'average_wait_minutes')},
        {r('list_sort(list(queue_wait_minutes))[1 + floor(0.95::DOUBLE * (count(*) - 1))::BIGINT]', 'p95_wait_minutes')},
        {r('max(queue_wait_minutes)', 'max_wait_minutes')}, {r('count(*) FILTER (queue_wait_minutes <= 15) / count(*) * 100', 'sla_percentage')},
        count(*) FILTER (queue_wait_minutes <= 15) / count(*) * 100 >= 95 AS meets_sla FROM pm GROUP BY 1""",
    "lab_summary": f"""SELECT lab_id, count(*) AS total_patients, count(*) AS patients_served, {r('sum(service_minutes)', 'total_service_minutes')},
        {r('sum(service_minutes) / (720 * 60 * 4)::DOUBLE', 'utilization')}, {r('count(*) / 720.0::DOUBLE', 'patients_per_hour')} FROM pm GROUP BY 1""",
    "sla_summary": f"""SELECT lab_id, count(*) AS total_patients, count(*) FILTER (queue_wait_minutes <= 15) AS patients_within_sla,
        count(*) FILTER (queue_wait_minutes > 15) AS patients_breaching_sla,
        {r('count(*) FILTER (queue_wait_minutes > 15) / count(*)', 'sla_breach_rate')} FROM pm GROUP BY 1""",
    "hourly_windows": rounded("w60", "lab_id, window_start, window_end, arrivals, patients_served", WIN_DOUBLES),
    "table_bounds": "SELECT lab_id, first_a AS first_arrival, last_a AS last_arrival, last_d AS last_departure FROM edge",
    "journey_summary": f"""SELECT count(*) AS patients, {r('avg(registration_minutes)', 'avg_registration')}, {r('avg(queue_wait_minutes)', 'avg_queue_wait')},
        {r('max(queue_wait_minutes)', 'max_queue_wait')}, {r('avg(service_minutes)', 'avg_service')}, {r('avg(total_journey_minutes)', 'avg_total_journey')},
        count(*) FILTER (waited) AS patients_who_waited, count(*) FILTER (sla_breached) AS sla_breaches FROM pm""",
    "rolled_up_totals": f"""SELECT count(*) AS total_patients, {r('avg(queue_wait_minutes)', 'average_wait')}, {r('max(queue_wait_minutes)', 'maximum_wait')},
        {r('avg(service_minutes)', 'average_service')}, {r('avg(total_journey_minutes)', 'average_journey')},
        count(*) FILTER (sla_breached) AS total_sla_breaches FROM pm""",
    "event_type_counts": "SELECT event_type, count(*) AS n FROM ev GROUP BY 1",
    "patient_type_shares": f"SELECT patient_type, count(*) AS n, {r('count(*) / (SELECT count(*) FROM lc) * 100', 'percentage')} FROM lc GROUP BY 1",
    "priority_shares": f"SELECT priority, count(*) AS n, {r('count(*) / (SELECT count(*) FROM lc) * 100', 'percentage')} FROM lc GROUP BY 1",
    "arrivals_by_hour": "SELECT extract('hour' FROM arrival_time)::INT AS hour, count(*) AS arrivals FROM lc GROUP BY 1",
    "distinct_patients": "SELECT count(*) AS events, count(DISTINCT patient_id) AS patients FROM ev",
    "queue_snapshots": "SELECT * FROM qs",
    "queue_snapshots_half_hourly": f"SELECT * FROM ({grid(30, 4)})",
    "queue_snapshots_all_labs": f"SELECT * FROM ({grid(5, SERVERS, False, anchor="date_trunc('minute', min(arrival_time))")})",
    "operational_state": rounded("st", OM_PLAIN + ", patients_waiting, patients_in_service, queue_pressure, operational_status",
                                 OM_DOUBLES + ", utilization_percentage"),
    "staffing_decisions": rounded("dec", "timestamp, lab_id, patients_waiting, patients_in_service, intervention_required, severity, additional_staff, reason", DEC_DOUBLES),
    "severity_counts": "SELECT severity, additional_staff, count(*) AS n FROM dec GROUP BY 1, 2",
    "windows_needing_attention": """SELECT window_start, lab_id, patients_waiting, queue_pressure, operational_status FROM st
        WHERE operational_status <> 'GREEN'""",
    "interventions_required": "SELECT timestamp, lab_id, severity, additional_staff, reason FROM dec WHERE intervention_required",
    "most_congested_windows": """SELECT window_start, lab_id, patients_waiting, operational_status FROM st
        ORDER BY patients_waiting DESC, window_start, lab_id LIMIT 20""",
    "waiting_at_windows": f"""SELECT g.lab_id, g.timestamp, p.patient_id, p.patient_type, p.queue_entry_time, {r('p.service_minutes', 'service_minutes')},
        {r(minutes('p.queue_entry_time', 'g.timestamp'), 'accrued_wait_minutes')}
        FROM qs g JOIN pm p ON p.lab_id = g.lab_id AND p.queue_entry_time <= g.timestamp AND p.service_start_time > g.timestamp""",
    "in_service_at_windows": f"""SELECT g.lab_id, g.timestamp, p.patient_id, p.service_start_time,
        {r(minutes('g.timestamp', 'p.service_end_time'), 'remaining_service_minutes')}
        FROM qs g JOIN pm p ON p.lab_id = g.lab_id AND p.service_start_time <= g.timestamp AND p.service_end_time > g.timestamp""",
    "arrivals_after_windows": f"""SELECT g.lab_id, g.t AS timestamp, p.patient_id, p.patient_type, {r('p.service_minutes', 'service_minutes')},
        {r(minutes('g.t', 'p.arrival_time'), 'offset_minutes')}
        FROM (SELECT lab_id, unnest(generate_series(time_bucket(INTERVAL 5 MINUTE, first_a) - INTERVAL 30 MINUTE, last_a, INTERVAL 5 MINUTE)) AS t FROM edge) g
        JOIN pm p ON p.lab_id = g.lab_id AND p.arrival_time >= g.t AND p.arrival_time < g.t + INTERVAL 30 MINUTE""",
    "history_before_windows": f"""SELECT g.lab_id, g.t AS timestamp, p.patient_id, p.patient_type, {r('p.service_minutes', 'service_minutes')}, p.arrival_time,
        CASE WHEN p.arrival_time < g.t - INTERVAL 15 MINUTE THEN 'OLDER' ELSE 'RECENT' END AS segment
        FROM (SELECT lab_id, unnest(generate_series(time_bucket(INTERVAL 5 MINUTE, first_a), last_a + INTERVAL 35 MINUTE, INTERVAL 5 MINUTE)) AS t FROM edge) g
        JOIN pm p ON p.lab_id = g.lab_id AND p.arrival_time >= g.t - INTERVAL 30 MINUTE AND p.arrival_time < g.t""",
    "arrival_counts_around": """SELECT lab_id, t AS window_start, last_30.n AS last_30, last_60.n AS last_60, last_90.n AS last_90,
        last_120.n AS last_120, next_30.n AS next_30 FROM last_30 JOIN last_60 USING (lab_id, t) JOIN last_90 USING (lab_id, t)
        JOIN last_120 USING (lab_id, t) JOIN next_30 USING (lab_id, t)""",
    "strategy_forecasts": rounded("pred", "lab_id, window_start, older, recent, actual", "rolling_rate, weighted_recent, trend_adjusted"),
    "strategy_errors": "SELECT * FROM strat",
    "best_strategy": "SELECT * FROM strat ORDER BY mae, abs(bias), rmse LIMIT 1",
    "lookback_errors": "SELECT * FROM look",
    "best_lookback": "SELECT * FROM look ORDER BY mae, abs(bias), rmse LIMIT 1",
    "timeline_positions": "SELECT lab_id, t AS timestamp, timeline_index FROM idx",
    "weighted_demand_profile": f"""SELECT lab_id, t AS timestamp, older.n AS older_count, recent.n AS recent_count,
        {r('(older.n / 15.0::DOUBLE + recent.n / 15.0::DOUBLE * 2) / 3', 'arrival_rate_per_minute')} FROM older JOIN recent USING (lab_id, t)""",
    "recent_demand_profile": f"""SELECT lab_id, t AS timestamp, older.n AS older_count, recent.n AS recent_count,
        {r('(older.n + recent.n) / 30.0::DOUBLE', 'arrival_rate_per_minute')} FROM older JOIN recent USING (lab_id, t)""",
    "staffing_scenarios": f"SELECT {CARD} FROM card",
    "recoverability": f"""SELECT lab_id, t AS window_start, initial_waiting + future_arrivals AS total_patients, breached AS already_breached_patients,
        {r('best', 'maximum_possible_sla_percentage')}, best >= 95 AS is_recoverable FROM info""",
    "recommendations": f"""SELECT {CARD.replace('lab_id,', 'c.lab_id,').replace('t AS window_start', 'c.t AS window_start').replace('x)', 'c.x)').replace('x::INT', 'c.x::INT')
                                   .replace('(round(', '(round(c.').replace('sla_percentage >= 95', 'c.sla_percentage >= 95')},
        p.decision, p.objective, {REASONS}, {r('c.sla_percentage - b.sla_percentage', 'sla_improvement_percentage_points')},
        {r('b.p95_wait_minutes - c.p95_wait_minutes', 'p95_improvement_minutes')}
        FROM pick p JOIN card b ON b.lab_id = p.lab_id AND b.t = p.t AND b.x = 0 JOIN card c ON c.lab_id = p.lab_id AND c.t = p.t AND c.x = p.x""",
    "scenario_report": f"""SELECT k.*, p.decision, p.x = k.additional_staff AS selected FROM (SELECT {CARD} FROM card) k
        JOIN pick p ON p.lab_id = k.lab_id AND p.t = k.window_start""",
    "full_timeline_backtest": "SELECT * FROM ft",
    "intervention_backtest": "SELECT * FROM bt",
    "backtest_comparison_counts": "SELECT comparison, counterfactual_decision, objective, count(*) AS n FROM bt GROUP BY 1, 2, 3",
    "backtest_staffing_totals": f"""SELECT count(*) AS windows, sum(rule_additional_staff)::BIGINT AS rule_total_staff, sum(model_additional_staff)::BIGINT AS model_total_staff,
        {r('avg(rule_additional_staff)', 'rule_average_staff')}, {r('avg(model_additional_staff)', 'model_average_staff')} FROM bt""",
    "policy_timeline": "SELECT * FROM pol",
    "policy_action_counts": "SELECT policy, policy_action, count(*) AS n FROM pol GROUP BY 1, 2",
    "policy_resources": "SELECT * FROM res",
    "policy_savings": f"""SELECT s.staff_hours AS base_hours, c.staff_hours AS other_hours, s.cost AS base_cost, c.cost AS other_cost,
        {r('(s.staff_window_units - c.staff_window_units) * 5 / 60.0::DOUBLE', 'staff_hours_avoided')},
        {r('(s.staff_window_units - c.staff_window_units) * 5 / 60.0::DOUBLE * 35.0::DOUBLE', 'cost_avoided')},
        {r('CASE WHEN s.staff_window_units > 0 THEN (s.staff_window_units - c.staff_window_units) / s.staff_window_units * 100 ELSE 0 END', 'hours_reduction_percentage')},
        {r('CASE WHEN s.staff_window_units > 0 THEN (s.staff_window_units - c.staff_window_units) / s.staff_window_units * 100 ELSE 0 END', 'cost_reduction_percentage')}
        FROM res s, res c WHERE s.policy = 'STATIC_RULE' AND c.policy = 'COUNTERFACTUAL'""",
    "staffing_change_counts": "SELECT policy, change_actions AS changes FROM res",
    "active_staff_windows": "SELECT policy, lab_id, timestamp, active_additional_staff, policy_action FROM pol WHERE active_additional_staff > 0",
    "mmc_by_window": f"""SELECT lab_id, window_start, {r('rho', 'utilization')}, {r('p0', 'probability_zero_customers')}, {r('pw', 'probability_wait')},
        {r('lq', 'average_queue_length')}, {r('lq / lam * 60', 'average_wait_minutes')}, {r('lq + a', 'average_system_length')},
        {r('(lq + a) / lam * 60', 'average_system_time_minutes')}
        FROM (SELECT *, CASE WHEN ok THEN 1 / (1 + a + last) END AS p0, CASE WHEN ok THEN last / (1 + a + last) END AS pw,
                     CASE WHEN ok THEN last / (1 + a + last) * rho / (1 - rho) END AS lq
              FROM (SELECT lab_id, window_start, lam, a, lam > 0 AND a < 2 AS ok, CASE WHEN lam > 0 AND a < 2 THEN a / 2 END AS rho,
                           a * a / 2 / nullif(1 - a / 2, 0) AS last
                    FROM (SELECT w.lab_id, window_start, arrivals / ({minutes('window_start', 'window_end')} / 60) AS lam,
                                 arrivals / ({minutes('window_start', 'window_end')} / 60) / mu.mu AS a
                          FROM w30 w JOIN mu ON mu.lab_id = w.lab_id)))""".replace("lq / lam * 60", "CASE WHEN ok THEN lq / lam * 60 END")
        .replace("(lq + a) / lam * 60", "CASE WHEN ok THEN (lq + a) / lam * 60 END"),
    "lab_service_rates": f"SELECT lab_id, {r('mu', 'service_rate_per_hour')} FROM mu",
    "window_service_rates": f"""SELECT lab_id, window_start,
        {r('CASE WHEN patients_served > 0 AND average_service_time_minutes > 0 THEN 60.0::DOUBLE / average_service_time_minutes END', 'service_rate_per_hour')} FROM w30""",
    "theory_comparison": "SELECT * FROM cmp",
    "theory_comparison_local": "SELECT * FROM cmpl",
    "theory_validation": f"""SELECT count(*) AS total_windows, count(*) FILTER (used) AS stable_windows, count(*) FILTER (NOT used) AS unstable_windows,
        {r('coalesce(avg(abs(e)), 0)', 'mean_absolute_error_minutes')}, {r('coalesce(sqrt(avg(e * e)), 0)', 'root_mean_squared_error_minutes')},
        {r('coalesce(avg(e), 0)', 'mean_bias_minutes')}, {r('coalesce(avg(theoretical_wait_minutes) FILTER (used), 0)', 'theoretical_mean_wait_minutes')},
        {r('coalesce(avg(observed_wait_minutes) FILTER (used), 0)', 'observed_mean_wait_minutes')}
        FROM (SELECT *, system_stable AND theoretical_wait_minutes IS NOT NULL AS used,
                     CASE WHEN system_stable THEN observed_wait_minutes - theoretical_wait_minutes END AS e FROM cmpl)""",
    "streamed_silver_events": """SELECT event_id, event_type, patient_id, lab_id, event_time, "partition", "offset",
        ingested AS kafka_timestamp, priority, staff_id, lag AS event_lag_seconds, is_late FROM silver""",
    "streamed_lifecycles": f"SELECT {STATE_COLS} FROM states",
    "streamed_hold_policy": """SELECT policy, lab_id, timestamp, instantaneous_recommendation, policy_action, staff_change,
        active_additional_staff, reason FROM pol WHERE policy = 'STATIC_RULE'
        AND timestamp < (SELECT max(timestamp) - INTERVAL 30 MINUTE FROM pol)""",
}
SELECTS["weighted_record_profile"] = f"""
    SELECT lab_id, window_start, patient_type, {r('service_minutes', 'service_minutes')}, older_count, recent_count,
           {r('weight', 'weight')}, {r('weight / sum(weight) OVER (PARTITION BY lab_id, window_start)', 'share')}
    FROM (SELECT om.lab_id, om.window_start, patient_type, service_minutes,
                 count(*) FILTER (arrival_time < om.window_start - INTERVAL 15 MINUTE) AS older_count,
                 count(*) FILTER (arrival_time >= om.window_start - INTERVAL 15 MINUTE) AS recent_count,
                 (older_count * 1 + recent_count * 2)::DOUBLE AS weight
          FROM om JOIN pm ON pm.lab_id = om.lab_id AND arrival_time >= om.window_start - INTERVAL 30 MINUTE AND arrival_time < om.window_start
          GROUP BY ALL)"""
INSTANTS = """(SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'LAB_A' ELSE 'LAB_B' END AS lab_id, ts::TIMESTAMP AS timestamp
               FROM events WHERE event_type = 'error')"""
SELECTS["queue_at_instants"] = f"""
    SELECT i.lab_id, i.timestamp, count(*) FILTER (queue_entry_time <= i.timestamp AND service_start_time > i.timestamp) AS patients_waiting,
           count(*) FILTER (service_start_time <= i.timestamp AND service_end_time > i.timestamp) AS patients_in_service
    FROM {INSTANTS} i LEFT JOIN pm ON pm.lab_id = i.lab_id AND queue_entry_time <= i.timestamp AND service_end_time > i.timestamp
    GROUP BY ALL"""
SELECTS["episode_at_instants"] = f"""
    SELECT i.lab_id, i.timestamp, 'WAITING' AS role, patient_id, patient_type, {r('service_minutes', 'service_minutes')},
           epoch_us(i.timestamp) - epoch_us(queue_entry_time) AS microseconds
    FROM {INSTANTS} i JOIN pm ON pm.lab_id = i.lab_id AND queue_entry_time <= i.timestamp AND service_start_time > i.timestamp
    UNION ALL SELECT i.lab_id, i.timestamp, 'SERVING', patient_id, patient_type, {r('service_minutes')}, epoch_us(service_end_time) - epoch_us(i.timestamp)
    FROM {INSTANTS} i JOIN pm ON pm.lab_id = i.lab_id AND service_start_time <= i.timestamp AND service_end_time > i.timestamp
    UNION ALL SELECT i.lab_id, i.timestamp, 'ARRIVING', patient_id, patient_type, {r('service_minutes')}, epoch_us(arrival_time) - epoch_us(i.timestamp)
    FROM {INSTANTS} i JOIN pm ON pm.lab_id = i.lab_id AND arrival_time >= i.timestamp AND arrival_time < i.timestamp + INTERVAL 30 MINUTE"""
# The sketches are exact for up to 4096 values, more than a lab has in a day of these tables.
SELECTS["rolled_up_p95"] = " UNION ALL ".join(f"""
    SELECT lab_id, time_bucket(INTERVAL {length}, arrival_time) AS window_start, count(*) AS patients,
           quantile_disc(queue_wait_minutes, 0.95) AS p95_queue_wait_minutes, '{length.lower()}' AS length FROM pm GROUP BY 1, 2"""
                                              for length in ("1 HOUR", "1 DAY"))
SELECTS["streamed_bronze"] = SELECTS["bronze_envelope"]
# Four time slices of equal length; an event counts where its record arrived, an id where it was read first.
SELECTS["streamed_batch_counts"] = """SELECT * FROM (
    WITH sliced AS (
        SELECT *, (epoch_us(ingested) - min(epoch_us(ingested)) OVER ())
                  // ((max(epoch_us(ingested)) OVER () - min(epoch_us(ingested)) OVER ()) // 4 + 1) AS slice FROM rec
    ), marked AS (
        SELECT *, fault NOT BETWEEN 1 AND 6 AS good FROM sliced
    ), behind AS (
        SELECT slice, max(max(event_time) FILTER (good)) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                      - INTERVAL 30 MINUTE AS mark FROM marked GROUP BY slice
    ), ids AS (
        SELECT event_id, slice, min(event_time) AS event_time FROM marked WHERE good GROUP BY 1, 2
    ), fresh AS (
        SELECT i.slice, count(*) FILTER (i.event_time < mark) AS dropped,
               count(*) FILTER (coalesce(i.event_time >= mark, true)
                                AND NOT EXISTS (SELECT 1 FROM ids e WHERE e.event_id = i.event_id AND e.slice < i.slice)) AS stored
        FROM ids i JOIN behind b ON b.slice = i.slice GROUP BY 1
    ), counted AS (
        SELECT slice, count(*) AS records, count(*) FILTER (good) AS accepted, count(*) FILTER (NOT good) AS rejected,
               count(*) FILTER (good AND lag > 300) AS late FROM marked GROUP BY slice
    )
    SELECT (row_number() OVER (ORDER BY slice) - 1)::INT AS slice, records, accepted, rejected, late,
           accepted - coalesce(stored, 0) - coalesce(dropped, 0) AS repeated, coalesce(dropped, 0) AS dropped, coalesce(stored, 0) AS stored
    FROM counted LEFT JOIN fresh USING (slice))"""
# Append mode emits a window once the watermark, 30 minutes behind the newest event, has passed its end.
SELECTS["streamed_window_counts"] = f"""SELECT * FROM ({SELECTS['event_window_counts']})
    WHERE window_end <= (SELECT max(event_time) - INTERVAL 30 MINUTE FROM silver)"""


# The gold chain starts from recorded events: durations come from the lifecycles these give.
CHAIN = CTES["pm"].replace("service_end_time AS departure_time", "departure_time").replace("FROM lc", """FROM states
WHERE arrival_time IS NOT NULL AND queue_entry_time IS NOT NULL AND service_start_time IS NOT NULL
  AND service_end_time IS NOT NULL AND departure_time IS NOT NULL""").replace(
    "minutes('arrival_time', 'service_end_time')", "minutes('arrival_time', 'departure_time')")
GOLD = {"gold_patient_metrics": "patient_metrics", "gold_operational_metrics": "operational_metrics", "gold_queue_metrics": "queue_snapshots",
        "gold_operational_state": "operational_state", "gold_staffing_decisions": "staffing_decisions",
        "gold_refreshed": "staffing_decisions"}

ORACLES: dict[str, str] = {name: statement(select) for name, select in SELECTS.items()}
ORACLES |= {name: statement(SELECTS[same], pm=CHAIN) for name, same in GOLD.items()}
