"""Session set-up shared by jobs, tests and the bench."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app_name: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session pinned to UTC with adaptive execution; cluster settings win over none given here."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Shuffle files go when the query or micro-batch they were written for has ended, not when the driver collects garbage.
DROP_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the length of a block; a stream that is started in it keeps them."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, as named in spark.checkpoint.dir.

    Only a local session, where driver and executors are one machine, falls back to a temporary one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="spark-")
    raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for the functions run in Python workers."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-"), package.name), "zip",
                                      package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
