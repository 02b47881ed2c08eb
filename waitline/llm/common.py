"""Small helpers the corpus operators share: text columns, blocks of consecutive ids, word arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waitline.sources.tables import lookup

LOWEST = -(1 << 63)
SPACES = "[\\x20\\x09-\\x0D]+"
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python workers a few megabytes at a time, whatever the number of rows; a size set by the user stays.

    A batch is held by the executor and by its worker, and neither gives such memory back when the task ends.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and whole text (null: empty), and nothing else but the columns named."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                       *[F.col(c) for c in more])


def word_array(text: Column) -> Column:
    """Words between ASCII white space, as they stand."""
    return F.filter(F.split(text, SPACES), lambda w: F.length(w) > 0)


def word_count(text: Column) -> Column:
    """Number of words without building them: starts of runs of other than ASCII white space."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def id_blocks(keys: DataFrame, key: str, per_block: int = 2048) -> Callable[[DataFrame], DataFrame]:
    """Adds `_block`, a number that keeps the order of a long key, with about per_block rows each.

    The key's range is cut evenly; a part of it that holds far more rows than that (ids in clusters far
    apart) is cut evenly once more. Only three numbers come to the driver.
    """
    low, high, n = keys.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    if not n:
        return lambda df: df.withColumn("_block", F.lit(0).cast("long"))
    wide = lambda x: x.cast("decimal(38,0)")  # noqa: E731  ids may span the whole range of a long
    outer = F.floor((wide(F.col(key)) - wide(F.lit(str(low)))) / wide(F.lit(str(_width(low, high, n, per_block))))).cast("long")
    crowded = keys.groupBy(outer.alias("_outer")).agg(
        F.min(key).alias("_low"), F.max(key).alias("_high"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 4 * per_block)
    crowded = lookup(crowded)
    if crowded.isEmpty():
        return lambda df: df.withColumn("_block", outer)
    parts = F.ceil(F.col("_n") / per_block)
    width = F.greatest(F.lit(1), F.ceil((wide(F.col("_high")) - wide(F.col("_low")) + 1) / wide(parts)))
    inner = F.coalesce(F.floor((wide(F.col(key)) - wide(F.col("_low"))) / wide(width)), F.lit(0)).cast("long")
    # Fewer than 2**31 outer and 2**32 inner parts.
    return lambda df: (df.withColumn("_outer", outer).join(crowded, "_outer", "left")
                       .withColumn("_block", F.shiftleft("_outer", 32) + inner).drop("_outer", "_low", "_high", "_n"))


def _width(low: int, high: int, n: int, per_block: int) -> int:
    return max(1, -(-(high - low + 1) // max(1, -(-n // per_block))))


def offsets(totals: DataFrame, block: str, size: str, fan: int = 4096) -> DataFrame:
    """Running total of all earlier blocks, by two levels so that no window holds more than fan blocks
    or one row per fan blocks."""
    upper = totals.withColumn("_upper", F.floor(F.col(block) / fan))
    sums = upper.groupBy("_upper").agg(F.sum(size).alias("_sum"))
    before = Window.orderBy("_upper").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_upper", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_upper").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return (upper.withColumn("_inner", F.coalesce(F.sum(size).over(inside), F.lit(0)))
            .join(sums, "_upper").select(block, (F.col("_base") + F.col("_inner")).alias("offset")))


# Inside tasks -------------------------------------------------------------------------------

def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def chunks(batches, size: int = 4 << 20):
    """Lists of (id, text) from Arrow batches, about size characters each; a longer text stands alone."""
    for batch in batches:
        ids, texts_ = batch.column("doc_id").to_pylist(), batch.column("text")
        held, n = [], 0
        for i, key in enumerate(ids):
            text = texts_[i].as_py() or ""
            held.append((key, text))
            n += len(text)
            if n >= size:
                yield held
                held, n = [], 0
        if held:
            yield held
