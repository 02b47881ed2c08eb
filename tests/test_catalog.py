"""Catalog queries against their DuckDB statements on the smallest tables."""

import pytest
from check_oracles import compare, connect

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
SAMPLE = ["silver_events", "event_window_counts", "published_events", "bronze_envelope", "operational_state", "hourly_windows",
          "strategy_errors", "recommendations", "full_timeline_backtest", "policy_timeline", "theory_comparison",
          "gold_staffing_decisions", "streamed_window_counts", "streamed_silver_events", "streamed_hold_policy"]


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_query(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "additional_staff" in df.columns


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_statement(spark, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    assert compare(got, connect(SMALL).execute(entry.oracle_sql()[name]).df()) == "ok"
