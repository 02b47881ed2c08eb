"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waitline.sources.tables import stage


def _lowest(edges: DataFrame, by: str) -> DataFrame:
    """Smallest neighbour (or itself) of each vertex; combined before the shuffle, so a hub is one row per task."""
    return edges.groupBy(by).agg(F.least(F.min("b" if by == "a" else "a"), F.col(by)).alias("low"))


def components(edges: DataFrame) -> DataFrame:
    """vertex, component (its smallest vertex) of every vertex of the edges (a, b)."""
    now = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    mark = None
    while True:
        # Large star: neighbours above a vertex move to its lowest neighbour.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _lowest(both, "a")
        moved = both.where("b > a").join(low, "a").select(F.col("low").alias("a"), "b").where("a < b").distinct()
        # Small star: a vertex and its lower neighbours move to the lowest of them.
        low = _lowest(moved, "b")
        down = moved.join(low, "b").select(F.col("low").alias("a"), F.col("a").alias("b"))
        now = stage(down.unionByName(low.select(F.col("low").alias("a"), F.col("b"))).where("a < b").distinct())
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == mark:
            break
        mark = found
    ends = now.select(F.col("b").alias("vertex"), F.col("a").alias("component"))
    roots = now.select(F.col("a").alias("vertex"), F.col("a").alias("component")).distinct()
    return ends.unionByName(roots)
