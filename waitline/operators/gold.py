"""Gold tables in one chain from de-duplicated events, and the jobs that refresh them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from waitline.operators import counterfactual, grid, lifecycle, windows
from waitline.params import Params
from waitline.sources import versions
from waitline.sources.tables import stage

NAMES = ("patient_metrics", "operational_metrics", "queue_metrics", "operational_state", "staffing_decisions")


def metrics_of(lifecycles: DataFrame, p: Params = Params()) -> DataFrame:
    """Durations and flags of the lifecycles that have run to their end."""
    return lifecycle.patient_metrics(lifecycles, p)


def tables(silver: DataFrame, p: Params = Params()) -> dict[str, DataFrame]:
    """All five tables from silver events. Patient metrics are stored once, as three tables read them."""
    metrics = stage(metrics_of(lifecycle.lifecycle_state(silver), p))
    operational = windows.operational_metrics(metrics, p)
    queue = grid.queue_snapshots(metrics, p)
    state = windows.operational_state(operational, queue)
    return dict(zip(NAMES, (metrics, operational, queue, state, counterfactual.staffing_decisions(state))))


def refresh_tables(spark: SparkSession, lifecycles: DataFrame, root: str, p: Params = Params(), keep: int = 2) -> int:
    """Compute and store the five tables in order, each from what the one before stored, and commit them as one version.

    Until the commit readers see the tables of the version before. Files of versions that are neither among
    the last `keep` nor under a reader's lease are deleted. Returns the version's number.
    """
    version = versions.latest(spark, root) + 1
    folder = versions.attempt(version)
    stored: dict[str, DataFrame] = {}

    def store(name: str, df: DataFrame) -> None:
        df.write.parquet(f"{root}/{folder}/{name}")
        stored[name] = spark.read.schema(df.schema).parquet(f"{root}/{folder}/{name}")

    store("patient_metrics", metrics_of(lifecycles, p))
    store("operational_metrics", windows.operational_metrics(stored["patient_metrics"], p))
    store("queue_metrics", grid.queue_snapshots(stored["patient_metrics"], p))
    store("operational_state", windows.operational_state(stored["operational_metrics"], stored["queue_metrics"]))
    store("staffing_decisions", counterfactual.staffing_decisions(stored["operational_state"]))
    note = {"tables": {name: f"{folder}/{name}" for name in NAMES}, "schemas": {name: df.schema.json() for name, df in stored.items()}}
    if not versions.commit(spark, root, version, note):
        raise RuntimeError(f"another refresh has stored version {version} of {root}")
    versions.expire(spark, root, keep)
    return version


def tables_of(spark: SparkSession, root: str, note: dict) -> dict[str, DataFrame]:
    schema = lambda name: T.StructType.fromJson(json.loads(note["schemas"][name]))
    return {name: spark.read.schema(schema(name)).parquet(f"{root}/{path}") for name, path in note["tables"].items()}


@contextmanager
def snapshot(spark: SparkSession, root: str) -> Iterator[dict[str, DataFrame]]:
    """All five tables of one version, whose files stay while the block runs."""
    with versions.lease(spark, root) as note:
        yield tables_of(spark, root, note)
