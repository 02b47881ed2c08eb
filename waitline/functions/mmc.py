"""Closed-form M/M/c results as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mmc(arrival_rate: Column, service_rate: Column, servers: Column) -> Column:
    """Struct of steady-state results; NULL when a rate is not positive or the load is >= 1.

    The partial sums of a^k/k! come from one fold over 0..c-1, each term built from the
    previous one, so no factorial is ever formed.
    """
    load = arrival_rate / service_rate
    rho = load / servers
    fold = F.aggregate(
        F.sequence(F.lit(1), servers),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda acc, k: F.struct(
            (acc["term"] * load / k).alias("term"),
            (acc["total"] + acc["term"]).alias("total"),
        ),
    )
    parts = F.struct(fold.alias("f"), rho.alias("rho"))
    last = parts["f"]["term"] / (F.lit(1.0) - parts["rho"])
    p0 = F.lit(1.0) / (parts["f"]["total"] + last)
    p_wait = last * p0
    lq = p_wait * rho / (F.lit(1.0) - rho)
    length = lq + load
    valid = (arrival_rate > 0) & (service_rate > 0) & (servers >= 1) & (rho < 1)
    return F.when(valid, F.struct(
        rho.alias("utilization"),
        p0.alias("probability_zero_customers"),
        p_wait.alias("probability_wait"),
        lq.alias("average_queue_length"),
        (lq / arrival_rate * 60).alias("average_wait_minutes"),
        length.alias("average_system_length"),
        (length / arrival_rate * 60).alias("average_system_time_minutes"),
    ))
