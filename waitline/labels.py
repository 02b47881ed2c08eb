"""Labels and texts that downstream reports match on literally."""

EVENT_TYPES = (
    "APPOINTMENT_CREATED",
    "PATIENT_ARRIVAL",
    "REGISTRATION_COMPLETED",
    "QUEUE_ENTERED",
    "STAFF_ASSIGNED",
    "SERVICE_STARTED",
    "SERVICE_COMPLETED",
    "PATIENT_DEPARTED",
    "APPOINTMENT_CANCELLED",
    "PATIENT_NO_SHOW",
)

# Lifecycle column -> event type that fills it.
LIFECYCLE_EVENTS = {
    "arrival_time": "PATIENT_ARRIVAL",
    "registration_completed_time": "REGISTRATION_COMPLETED",
    "queue_entry_time": "QUEUE_ENTERED",
    "service_start_time": "SERVICE_STARTED",
    "service_end_time": "SERVICE_COMPLETED",
    "departure_time": "PATIENT_DEPARTED",
}

# Quarantine reasons in the order they are tested, with the field each one needs.
MALFORMED = "MALFORMED_JSON"
MISSING_FIELD_REASONS = (
    ("event_id", "MISSING_EVENT_ID"),
    ("event_type", "MISSING_EVENT_TYPE"),
    ("patient_id", "MISSING_PATIENT_ID"),
    ("lab_id", "MISSING_LAB_ID"),
    ("event_time", "MISSING_EVENT_TIME"),
)

# Staffing rule ladder: severity -> (additional staff, reason).
STAFFING_RULES = {
    "CRITICAL": (2, "Severe queue congestion detected. Deploy two additional staff."),
    "HIGH": (1, "Queue pressure is increasing. Deploy one additional staff member."),
    "WATCH": (1, "All service capacity is occupied while patients are waiting."),
    "NORMAL": (0, "No staffing intervention required."),
}

# Recommendation decision -> (objective, reason).
DECISIONS = {
    "DAMAGE_CONTROL": (
        "RESOURCE_AWARE_DAMAGE_CONTROL",
        "The SLA target is no longer mathematically recoverable. "
        "The recommendation maximizes achievable SLA and adds further capacity only when "
        "the reduction in P95 waiting time is operationally meaningful.",
    ),
    "NO_ACTION_REQUIRED": (
        "SLA_RESTORATION",
        "The minimum feasible staffing scenario capable of restoring the SLA was identified.",
    ),
    "STAFFING_INTERVENTION": (
        "SLA_RESTORATION",
        "The minimum feasible staffing scenario capable of restoring the SLA was identified.",
    ),
    "SEARCH_LIMIT_REACHED": (
        "BEST_EFFORT",
        "The SLA is theoretically recoverable, but no tested staffing level restored it. "
        "The best resource-aware scenario within the configured search range was returned.",
    ),
}

# Hold-policy outcome -> (action, reason).
HOLD_STEPS = {
    "idle": ("NO_ACTION", "No additional staffing required."),
    "deploy": ("DEPLOY", "Additional capacity deployed."),
    "escalate": (
        "ESCALATE",
        "Additional capacity increased because the required staffing level rose.",
    ),
    "keep": ("HOLD", "Current staffing intervention remains appropriate."),
    "wait": ("HOLD", "Minimum intervention hold period has not yet elapsed."),
    "release": ("RELEASE", "Additional capacity released after the hold period."),
    "reduce": ("DEESCALATE", "Additional capacity reduced after the hold period."),
}

STAFF_CHANGES = ("DEPLOY", "ESCALATE", "DEESCALATE", "RELEASE")

# Lookbacks of the forecast comparison, in minutes.
LOOKBACKS = (30, 60, 90, 120)
