"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR   tables to read (default /root/testdata/sf0.1)
    BENCH_CPUS     local threads (default 8)
    BENCH_QUERIES  comma-separated names (default: the headline list)
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "silver_events", "event_window_counts", "lifecycle_states", "patient_metrics", "operational_metrics",
    "queue_snapshots", "operational_state", "staffing_decisions", "hourly_windows", "strategy_errors", "lookback_errors",
    "theory_comparison_local", "recommendations", "full_timeline_backtest", "policy_resources", "gold_staffing_decisions",
    "streamed_silver_events", "streamed_window_counts",
]


def main() -> None:
    from waitline.plans.catalog import QUERIES
    from waitline.sources.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's code paths and the Python workers before the clock runs.
    QUERIES["recommendations"](spark, folder.rsplit("/", 1)[0] + "/sf0.001").count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
