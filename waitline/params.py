"""Job parameters, checked once when a job is configured."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Every knob of the batch and streaming jobs, with the usual clinic defaults."""

    # Service-level targets and staffing defaults.
    queue_sla_minutes: float = 15.0
    target_sla_percentage: float = 95.0
    window_minutes: int = 5
    staff_count: int = 4
    max_additional_staff: int = 6
    min_p95_gain_minutes: float = 2.0
    lookahead_minutes: int = 30
    segment_minutes: int = 15
    older_weight: float = 1.0
    recent_weight: float = 2.0
    trend_strength: float = 0.5
    hold_minutes: int = 15
    hourly_cost: float = 35.0
    late_after_seconds: int = 300
    watermark: str = "30 minutes"
    # Off: an event_id is never stored twice. On: a new event is only compared with stored ones that
    # are not older than the watermark, so less is read, and an id sent again much later comes back.
    bounded_dedup: bool = False
    # Accuracy of the approximate P95 of a window's waits: exact while a (lab, window) holds no more
    # distinct waits than this, and within 1/accuracy of the rank beyond.
    p95_accuracy: int = 10_000
    # What to do when more customers are in service than there are stations:
    # "error" stops the job, "queue" lets the surplus hold the next free station.
    on_overflow: str = "error"

    def __post_init__(self) -> None:
        checks = {
            "the queue target needs a positive number of minutes": self.queue_sla_minutes > 0,
            "the target share is a percentage above 0": 0 < self.target_sla_percentage <= 100,
            "windows need a positive length": self.window_minutes > 0,
            "a lab has one station or more": self.staff_count >= 1,
            "extra staff is counted from 0": self.max_additional_staff >= 0,
            "the lookahead needs a positive length": self.lookahead_minutes > 0,
            "segments need a positive length": self.segment_minutes > 0,
            "weights of both halves of the history are above 0": self.older_weight > 0 and self.recent_weight > 0,
            "the trend only strengthens: 0 or more": self.trend_strength >= 0,
            "an hour costs 0 or more": self.hourly_cost >= 0,
            "a hold lasts 0 minutes or more": self.hold_minutes >= 0,
            "surplus customers either stop the job (error) or wait (queue)": self.on_overflow in ("error", "queue"),
            "the lookahead is a whole number of windows": self.lookahead_minutes % self.window_minutes == 0,
            "a segment is a whole number of windows": self.segment_minutes % self.window_minutes == 0,
        }
        for message, holds in checks.items():
            if not holds:
                raise ValueError(message)

    @property
    def step_us(self) -> int:
        return self.window_minutes * 60_000_000
