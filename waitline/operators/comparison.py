"""Observed windows against M/M/c theory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waitline.functions.clock import micros
from waitline.functions.mmc import mmc

HOUR_US = 3_600_000_000


def service_rate(metrics: DataFrame) -> DataFrame:
    """Customers per hour one server handles, per lab; no row where service takes no time."""
    mean = metrics.groupBy("lab_id").agg(F.avg("service_minutes").alias("_mean"))
    return mean.filter(F.col("_mean") > 0).select("lab_id", (F.lit(60.0) / F.col("_mean")).alias("service_rate_per_hour"))


def window_service_rate(windows: DataFrame) -> DataFrame:
    """The same per window of completion, NULL when nothing completed."""
    mean = F.col("average_service_time_minutes")
    return windows.withColumn("service_rate_per_hour", F.when(
        (F.col("patients_served") > 0) & (mean > 0), F.lit(60.0) / mean))


def compare(windows: DataFrame, servers: int, metrics: DataFrame | None = None) -> DataFrame:
    """Theoretical and observed waits per window.

    With `metrics` the lab's overall service rate is used, otherwise the rate of the services
    completed in the window. Windows without arrivals, overloaded windows and windows without
    a local rate have their own outcomes.
    """
    if servers < 1:
        raise ValueError("a queue has one server or more")
    local = metrics is None
    w = window_service_rate(windows) if local else windows.join(service_rate(metrics), "lab_id")
    hours = (micros("window_end") - micros("window_start")) / F.lit(float(HOUR_US))
    w = w.withColumn("_rate", F.col("arrivals") / hours).withColumn("_mu", F.col("service_rate_per_hour"))
    rho = F.col("_rate") / (F.lit(servers) * F.col("_mu"))
    w = w.withColumn("_rho", rho).withColumn("_wq", mmc(F.col("_rate"), F.col("_mu"), F.lit(servers))["average_wait_minutes"])
    unknown, idle, over = F.col("_mu").isNull(), F.col("_rate") == 0, F.col("_rho") >= 1
    seen = F.col("average_queue_wait_minutes")
    idle_error = F.lit(0.0) if local else F.when(seen == 0, F.lit(0.0))
    none = F.lit(None).cast("double")
    return w.select(
        "lab_id", "window_start", "window_end",
        F.when(unknown | idle, 0.0).otherwise(F.col("_rate")).alias("arrival_rate_per_hour"),
        F.coalesce("_mu", F.lit(0.0)).alias("service_rate_per_hour"),
        F.lit(servers).alias("server_count"),
        F.when(unknown | idle, 0.0).otherwise(F.col("_rho")).alias("theoretical_utilization"),
        F.when(unknown, none).when(idle, 0.0).when(over, none).otherwise(F.col("_wq")).alias("theoretical_wait_minutes"),
        seen.alias("observed_wait_minutes"),
        F.when(unknown, none).when(idle, -seen).when(over, none).otherwise(seen - F.col("_wq"))
        .alias("wait_difference_minutes"),
        F.when(unknown, none).when(idle, idle_error).when(over, none)
        .when(F.col("_wq") > 0, (seen - F.col("_wq")) / F.col("_wq")).alias("relative_error"),
        (unknown | idle | ~over).alias("system_stable"))


def validation_summary(comparisons: DataFrame) -> DataFrame:
    """Agreement over windows that are stable and have a theoretical wait; others are unstable."""
    used = F.col("system_stable") & F.col("theoretical_wait_minutes").isNotNull()
    error = F.when(used, F.col("observed_wait_minutes") - F.col("theoretical_wait_minutes"))

    def mean(c):
        return F.coalesce(F.avg(c), F.lit(0.0))

    return comparisons.agg(
        F.count("*").alias("total_windows"), F.count_if(used).alias("stable_windows"),
        (F.count("*") - F.count_if(used)).alias("unstable_windows"),
        mean(F.abs(error)).alias("mean_absolute_error_minutes"),
        F.sqrt(mean(error * error)).alias("root_mean_squared_error_minutes"),
        mean(error).alias("mean_bias_minutes"),
        mean(F.when(used, F.col("theoretical_wait_minutes"))).alias("theoretical_mean_wait_minutes"),
        mean(F.when(used, F.col("observed_wait_minutes"))).alias("observed_mean_wait_minutes"))
