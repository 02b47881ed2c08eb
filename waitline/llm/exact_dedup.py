"""Exact dedup: group by 128-bit content hash, keep one stable id, compare bytes inside groups.

Defined cases: a null text counts as empty; a null doc_id sorts below all ids and stays null in the
result; repeated rows form a group like any copies, all with one doc_id; no rows give no rows; other
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waitline.llm.common import texts
from waitline.sources.tables import stage


def content_hash(text: Column) -> Column:
    """128 bits: the MD5 digest as binary."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, keep: str = "min", digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Texts are first combined under (hash, text): Spark compares the bytes of the grouping key, so a
    collision of hashes gives two classes, and a group holding a third of all rows is one row per task
    before the shuffle. Rows then find their class by hash alone. Only hashes shared by different
    texts (none in practice) take the second way, which joins by text as well.
    """
    return _members(docs, keep, digest).drop("h")


def _members(docs: DataFrame, keep: str, digest: Callable[[Column], Column]) -> DataFrame:
    rows = texts(docs).withColumn("h", digest(F.col("text")))
    best = F.min("doc_id") if keep == "min" else F.max("doc_id")
    classes = rows.groupBy("h", "text").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    hashes = stage(classes.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.first("keep_id").alias("keep_id"),
                                            F.first("group_size").alias("group_size")))
    sha = F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    out = rows.select("doc_id", "h", sha).join(hashes.where("n = 1").drop("n"), "h")
    if not hashes.where("n > 1").isEmpty():
        shared = hashes.where("n > 1").select("h")
        apart = classes.join(shared, "h", "left_semi")
        out = out.unionByName(rows.join(apart, ["h", "text"]).select("doc_id", "h", sha, "keep_id", "group_size"))
    return out.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256", "h")


def drop_copies(docs: DataFrame, keep: str = "min") -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat both id and text, one stays."""
    kept = _members(docs, keep, content_hash).where("kept").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    own = content_hash(F.coalesce(docs["text"], F.lit("")))
    same = docs["doc_id"].cast("long").eqNullSafe(kept["_id"]) & (own == kept["_h"])
    return docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"])
