"""Exact order statistics of large groups from value counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def wait_scorecard(df: DataFrame, keys: Sequence[str], wait: str, sla: float, target: float,
                   sums: Sequence[str] = ()) -> DataFrame:
    """Count, mean, maximum, floor-index P95 and SLA share of waits per group, plus sums of other columns.

    Waits are first counted per distinct value, which combines on the map side, so a group
    with any number of rows reaches the ranking step as its distinct values only.
    """
    keys = list(keys)
    freq = df.groupBy(*keys, F.col(wait).alias("_v")).agg(F.count("*").alias("_n"), *[F.sum(c).alias(c) for c in sums])
    upto = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    ranked = freq.select("*", F.sum("_n").over(upto).alias("_cum"), F.sum("_n").over(whole).alias("_all"))
    index = F.floor(F.lit(0.95) * (F.col("_all") - 1))
    scored = ranked.groupBy(*keys).agg(
        F.max("_all").alias("patients"),
        (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("average_wait_minutes"),
        F.min(F.when(F.col("_cum") > index, F.col("_v"))).alias("p95_wait_minutes"),
        F.max("_v").alias("max_wait_minutes"),
        (F.sum(F.when(F.col("_v") <= sla, F.col("_n")).otherwise(0)) / F.sum("_n") * 100)
        .alias("sla_percentage"),
        *[F.sum(c).alias(c) for c in sums],
    )
    return scored.withColumn("meets_sla", F.col("sla_percentage") >= F.lit(float(target)))
