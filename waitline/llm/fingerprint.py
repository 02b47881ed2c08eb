"""Document fingerprints: a threshold-scaled sketch in DataFrame functions only.

A document's sketch holds every distinct shingle hash in the lowest 1/fraction of the hash range.
Sketches of unequal sizes stay comparable and merge by union, since each hash is kept or not by its
own value; the containment of one document in another is the share of its kept hashes found there.
A sketch of one hash at most (short texts) says little; the exact containment of such texts by all shingles
is a column of its own.

Defined cases: a null text counts as empty and has an empty sketch; a text of fewer words than a
shingle is one shingle, and is sought in another text by shingles of its own width; the printed
fingerprint of a text none of whose hashes lies under the threshold is its smallest one, so that short
texts stay distinguishable (its sketch is empty); a very long text is hashed whole, in memory
of some ten times its size; rows that repeat an id are ordered by text; a null id comes
after all others in descending order; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waitline.llm.common import LOWEST, id_blocks, texts, word_array
from waitline.sources.tables import lookup

SHINGLE, FRACTION = 5, 4


def once(value: Column, use) -> Column:
    """Name an intermediate value inside one expression, so that it is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingles(words: Column, width: Column | int) -> Column:
    """Hashes of all runs of width words; of all words if they are fewer."""
    whole = F.when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))
    return F.when(F.size(words) >= width, hashes).otherwise(whole)


def sketch(text: Column, shingle: int = SHINGLE, fraction: int = FRACTION) -> Column:
    """Sorted distinct shingle hashes under the threshold, from the whole text."""
    limit = LOWEST + (1 << 64) // fraction
    low = F.filter(once(word_array(text), lambda w: shingles(w, shingle)), lambda h: h < F.lit(limit))
    return F.array_sort(F.array_distinct(low))


def printed(text: Column, kept: Column, shingle: int = SHINGLE) -> Column:
    """The hashes a fingerprint shows: the sketch or, of an empty one, the text's smallest hash.

    That hash lies above the threshold, so it is in no sketch and meets its equal only.
    """
    smallest = F.array_min(once(word_array(text), lambda w: shingles(w, shingle)))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array_compact(F.array(smallest)))


def as_text(hashes: Column) -> Column:
    """Sixteen hexadecimal digits for each hash."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller sketch's hashes that the other holds, 0 to 1; equal sketches give 1."""
    least = F.least(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b)) / least
    return F.when(a == b, 1.0).when(least == 0, 0.0).otherwise(shared)


def text_containment(text_a: Column, a: Column, text_b: Column, b: Column, shingle: int = SHINGLE) -> Column:
    """Containment by all shingles of two texts where one of their sketches a and b holds one hash at most, else null."""
    def exact(w: Column) -> Column:
        # Empty texts have no width; shingles() then gives no hash for them.
        width = F.greatest(F.lit(1), F.least(F.lit(shingle), F.when(F.size(w["a"]) > 0, F.size(w["a"])), F.when(F.size(w["b"]) > 0, F.size(w["b"]))))
        both = once(F.struct(w["a"].alias("a"), w["b"].alias("b"), width.alias("n")), lambda x: F.struct(
            F.array_distinct(shingles(x["a"], x["n"])).alias("a"), F.array_distinct(shingles(x["b"], x["n"])).alias("b")))
        return once(both, lambda x: containment(F.array_sort(x["a"]), F.array_sort(x["b"])))

    words = F.struct(word_array(text_a).alias("a"), word_array(text_b).alias("b"))
    return F.when(F.least(F.size(a), F.size(b)) <= 1, once(words, exact))


def merge(a: Column, b: Column) -> Column:
    """Sketch of both documents together."""
    return F.array_sort(F.array_union(a, b))


def with_next(docs: DataFrame, per_block: int = 2048) -> DataFrame:
    """Every document with the text and sketch of the one that follows in descending doc_id; the first follows the last.

    Documents meet in blocks of neighbouring ids, one shuffle of the texts in all. Each block also gets
    the top document of the block below, so no window reaches over more than a block.
    """
    rows = texts(docs).withColumn("_key", F.coalesce("doc_id", F.lit(LOWEST)))
    keys = rows.select("_key")
    placed_in = id_blocks(keys, "_key", per_block)
    tops = placed_in(keys).groupBy("_block").agg(F.max("_key").alias("_top"))
    # The block below, by two levels of windows: within a span of blocks, and between spans.
    spans = tops.withColumn("_span", F.floor(F.col("_block") / 4096))
    ends = spans.groupBy("_span").agg(F.max("_block").alias("_last"), F.min("_block").alias("_first"))
    order = Window.orderBy("_span")
    whole = Window.partitionBy()
    ends = ends.select("_span", F.coalesce(F.lag("_last").over(order), F.max("_last").over(whole)).alias("_outer"))
    inner = F.lag("_block").over(Window.partitionBy("_span").orderBy("_block"))
    below = spans.withColumn("_inner", inner).join(ends, "_span").select(
        "_block", F.coalesce("_inner", "_outer").alias("_below"))
    halo = lookup(below.join(tops.withColumnRenamed("_block", "_below"), "_below").select(
        F.col("_top").alias("_key"), F.col("_block").alias("_to")))
    seen = placed_in(rows.withColumn("sketch", sketch(F.col("text")))).join(halo, "_key", "left")
    own = F.struct(F.col("_block").alias("block"), F.lit(True).alias("own"))
    copy = F.when(F.col("_to").isNotNull(), F.struct(F.col("_to").alias("block"), F.lit(False).alias("own")))
    placed = (seen.withColumn("_at", F.explode(F.array_compact(F.array(own, copy))))
              .select("doc_id", "_key", "text", "sketch", F.col("_at.block").alias("_in"), F.col("_at.own").alias("_own")))
    w = Window.partitionBy("_in").orderBy(F.desc("_own"), F.desc("_key"), "text")
    return (placed.withColumn("next_text", F.lead("text").over(w)).withColumn("next_sketch", F.lead("sketch").over(w))
            .where("_own").select("doc_id", "text", "sketch", "next_text", "next_sketch"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each document and of its text with the last third replaced by the next document's beginning.

    near_edited and near_next follow from the fingerprints alone. exact_edited and exact_next are the containment by
    all shingles where a sketch is too small to tell (one hash at most), else null.
    """
    n = F.length("text").cast("long")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (n - third).cast("int")), F.substring("next_text", F.lit(1), third))
    both = with_next(docs).select("doc_id", "text", "next_text", n.alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    both = both.withColumn("edited_sketch", sketch(F.col("edited")))
    shown = both.select(
        "*", printed(F.col("text"), F.col("sketch")).alias("shown"), printed(F.col("edited"), F.col("edited_sketch")).alias("shown_edited"),
        printed(F.col("next_text"), F.col("next_sketch")).alias("shown_next"))
    return shown.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("shown")).alias("fingerprint"), as_text(F.col("shown_edited")).alias("edited_fingerprint"),
        containment(F.col("shown"), F.col("shown_edited")).alias("near_edited"),
        containment(F.col("shown"), F.col("shown_next")).alias("near_next"),
        text_containment(F.col("text"), F.col("sketch"), F.col("edited"), F.col("edited_sketch")).alias("exact_edited"),
        text_containment(F.col("text"), F.col("sketch"), F.col("next_text"), F.col("next_sketch")).alias("exact_next"))
