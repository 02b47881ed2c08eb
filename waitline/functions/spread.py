"""Running totals and trailing windows over long per-key series without one task per key.

A series is cut into blocks of cells. Totals of earlier blocks are added to a running
total inside the block; neighbouring rows needed by a bounded window are copied in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_CELLS = 288


def by_work(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition rows whose cost is computing, not bytes.

    A given partition count keeps adaptive execution from merging small partitions, which
    would put hours of replays into one task because their input is only a few megabytes.
    Several partitions per core even out groups that take longer than others.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def with_block(df: DataFrame, cell: str = "cell") -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(cell) / F.lit(BLOCK_CELLS)))


def running(df: DataFrame, keys: Sequence[str], measures: dict[str, str], cell: str = "cell",
            how: str = "sum", order: str | None = None, inclusive: bool = True) -> DataFrame:
    """Add running sums or maxima of measures along the cells of each key."""
    fold = {"sum": F.sum, "max": F.max}[how]
    df = with_block(df, cell)
    keys = list(keys)
    totals = df.groupBy(*keys, "_block").agg(*[fold(m).alias(f"_t_{m}") for m in measures])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_block",
                            *[fold(f"_t_{m}").over(before).alias(f"_c_{m}") for m in measures])
    inside = (Window.partitionBy(*keys, "_block").orderBy(order or cell)
              .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    joined = df.join(carried, [*keys, "_block"])

    def total(m: str):
        local = fold(m).over(inside)
        if how == "max":
            return F.greatest(local, F.col(f"_c_{m}"))
        return F.coalesce(local, F.lit(0)) + F.coalesce(F.col(f"_c_{m}"), F.lit(0))

    return joined.select(*df.columns, *[total(m).alias(out) for m, out in measures.items()]).drop("_block")


def with_neighbours(df: DataFrame, before: int, after: int, cell: str = "cell") -> DataFrame:
    """Copy each row to every block whose windows may look at it; `_own` marks the original."""
    lo = F.floor((F.col(cell) - after) / F.lit(BLOCK_CELLS))
    hi = F.floor((F.col(cell) + before) / F.lit(BLOCK_CELLS))
    own = F.floor(F.col(cell) / F.lit(BLOCK_CELLS))
    return (df.withColumn("_block", F.explode(F.sequence(lo, hi)))
            .withColumn("_own", F.col("_block") == own))
