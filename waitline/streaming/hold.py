"""The hold policy as a stateful stream, one state per (policy, lab)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from waitline.labels import HOLD_STEPS
from waitline.operators.policy import hold_step
from waitline.params import Params
from waitline.sources.session import ship_package
from waitline.streaming.state import use_rocksdb

OUTPUT = ("policy string, lab_id string, timestamp timestamp, instantaneous_recommendation int, "
          "policy_action string, staff_change int, active_additional_staff int, reason string")


class HoldPolicy(StatefulProcessor):
    """Rows wait in a map by their millisecond, with a timer each, until the watermark has passed them.

    So a micro-batch touches the rows it brings and those that become due, whatever else is waiting. Beside
    them the state holds the staff deployed, the end of the hold and the time of the last row.
    """

    def __init__(self, hold_us: int, forget_us: int | None):
        self.hold_us, self.forget_us = hold_us, forget_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long", "rows array<struct<us: long, asked: int>>")
        self.deployed = handle.getValueState("deployed", "active int, until long, last long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        brought: dict[int, list[tuple[int, int]]] = {}
        for r in rows:
            brought.setdefault(r["us"] // 1000, []).append((r["us"], r["instantaneous_recommendation"]))
        for ms, some in brought.items():
            known = self.waiting.getValue((ms,)) if self.waiting.containsKey((ms,)) else None
            self.waiting.updateValue((ms,), ([*map(tuple, known[0]), *some] if known else some,))
            self.handle.registerTimer(ms + 1)  # once the watermark has passed it
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        ms = expiredTimerInfo.getExpiryTimeInMs() - 1
        state = self.deployed.get()
        active, until, last = tuple(state) if state is not None else (0, -1, -1)
        out = []
        if self.waiting.containsKey((ms,)):
            for at, wanted in sorted(map(tuple, self.waiting.getValue((ms,))[0])):
                name, now, until = hold_step(at, wanted, active, until, self.hold_us)
                action, reason = HOLD_STEPS[name]
                out.append(Row(policy=key[0], lab_id=key[1], us=at, instantaneous_recommendation=wanted, policy_action=action,
                               staff_change=now - active, active_additional_staff=now, reason=reason))
                active, last = now, at
            self.waiting.removeKey((ms,))
            self.deployed.update((active, until, last))
            if self.forget_us is not None:
                self.handle.registerTimer((last + self.forget_us) // 1000 + 2)
        elif self.forget_us is not None and ms * 1000 > last + self.forget_us:
            self.deployed.clear()
        return iter(out)

    def close(self) -> None:
        pass


def hold_policy_stream(steps: DataFrame, p: Params = Params(), forget_minutes: float | None = None) -> DataFrame:
    """Actions for a stream of (policy, lab_id, timestamp, instantaneous_recommendation).

    Rows may come out of order by up to `p.watermark`: they are taken in time order once the watermark has
    passed them, whatever micro-batch brought them. A lab without a row for `forget_minutes` (default: never)
    has ended: its state goes, and should it open again it begins without extra staff.
    """
    spark = steps.sparkSession
    use_rocksdb(spark)
    ship_package(spark)
    rows = steps.withWatermark("timestamp", p.watermark).selectExpr("*", "unix_micros(timestamp) AS us")
    forget = None if forget_minutes is None else int(forget_minutes * 60_000_000)
    policy = HoldPolicy(p.hold_minutes * 60_000_000, forget)
    walked = rows.groupBy("policy", "lab_id").transformWithState(
        policy, OUTPUT.replace("timestamp timestamp", "us long"), "append", "EventTime")
    columns = [c.split()[0] for c in OUTPUT.split(", ")]
    return walked.selectExpr(*["timestamp_micros(us) AS timestamp" if c == "timestamp" else c for c in columns])
