"""Row-level rules as plain Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waitline.labels import MALFORMED, MISSING_FIELD_REASONS, STAFFING_RULES


def quarantine_reason(event: str = "event", corrupt: Column | None = None) -> Column:
    """First reason an event cannot be used, NULL when it is valid."""
    bad = F.col(event).isNull()
    reason = F.when(bad if corrupt is None else bad | corrupt, F.lit(MALFORMED))
    for field, label in MISSING_FIELD_REASONS:
        reason = reason.when(F.col(f"{event}.{field}").isNull(), F.lit(label))
    return reason


def event_lag_seconds(ingested: str, event_time: str) -> Column:
    return (F.unix_timestamp(F.col(ingested).cast("timestamp"))
            - F.unix_timestamp(F.col(event_time).cast("timestamp")))


# The limits of pressure, status and severity below.

def queue_pressure(waiting: Column) -> Column:
    return (F.when(waiting == 0, "NONE").when(waiting <= 3, "LOW")
            .when(waiting <= 7, "MODERATE").otherwise("HIGH"))


def operational_status(waiting: Column, compliance: Column, utilization: Column) -> Column:
    return (F.when((waiting >= 8) | (compliance < 80), "RED")
            .when((waiting >= 4) | (utilization >= 100) | (compliance < 95), "AMBER")
            .otherwise("GREEN"))


def severity(waiting: Column, compliance: Column, p95: Column, utilization: Column) -> Column:
    """Staffing rule ladder; a NULL metric never triggers a rung."""
    return (F.when((waiting >= 8) | (compliance < 80) | (p95 >= 20), "CRITICAL")
            .when((waiting >= 4) | (p95 >= 10), "HIGH")
            .when((utilization >= 100) & (waiting > 0), "WATCH")
            .otherwise("NORMAL"))


def severity_lookup(level: Column, position: int) -> Column:
    """Additional staff (position 0) or reason text (position 1) of a severity."""
    picked = F.lit(None)
    for name, row in STAFFING_RULES.items():
        picked = F.when(level == name, F.lit(row[position])).otherwise(picked)
    return picked


def rule_versus_model(decision: Column, rule_staff: Column, model_staff: Column) -> Column:
    return (F.when(decision.isin("DAMAGE_CONTROL", "SEARCH_LIMIT_REACHED"), decision)
            .when(model_staff.isNull(), "UNKNOWN")
            .when(rule_staff > model_staff, "RULE_OVERSTAFFS")
            .when(rule_staff < model_staff, "RULE_UNDERSTAFFS")
            .otherwise("ALIGNED"))


def staffing_cost(staff_hours: Column, hourly_cost: float) -> Column:
    """Cost of staff hours; negative hours stop the job."""
    if hourly_cost < 0:
        raise ValueError("an hour of staff costs 0 or more")
    return (F.when(staff_hours < 0, F.raise_error(F.lit("hours of staff below 0")).cast("double"))
            .otherwise(staff_hours * F.lit(float(hourly_cost))))


def window_hours(units: Column, window_minutes: int) -> Column:
    """Staff-window units to staff hours."""
    return units * F.lit(window_minutes) / F.lit(60.0)


def percent_of(part: Column, whole: Column) -> Column:
    """part/whole as a percentage, 0 when the whole is 0."""
    return F.when(whole != 0, part / whole * 100).otherwise(F.lit(0.0))
