"""Near-dedup by b-bit MinHash: banded candidates, bit-count estimates, exact confirmation on full sets.

A document's set is its distinct word shingles. Documents with equal sets are one class from the start,
so a group of copies costs one row. Of each class, 125 minima give 25 bands of five for candidates, and the
low two bits of every minimum, packed into four longs, give a similarity estimate: the share of equal
entries, corrected for chance matches. Pairs that the estimate does not rule out are confirmed exactly.

Inside a band bucket nobody is compared with everybody. First each member meets the bucket's hub (chosen
anew by hash in every band). Where a bucket still spans several components, members of different ones
meet in a second pass, whose join confirms pairs in its condition. So a link is lost only if a pair shares
no band (5e-5 at similarity 0.8), or shares one and the estimate rules it out (1.4e-4; together 1.9e-4,
for independent minima).

Defined cases: a null text counts as empty; no words, no set: linked with nothing; fewer words than a
shingle: the whole sequence is one; rows that repeat an id are one document with all their links; a null
id counts as the smallest id and stays null; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waitline.llm.common import LOWEST, chunks, small_batches, texts, word_hashes
from waitline.llm.components import components
from waitline.sources.session import ship_package
from waitline.sources.tables import lookup, stage

BANDS, ROWS, BITS = 25, 5, 2
SIMILARITY = 80  # per cent
# Four standard deviations of the estimate below the threshold.
ESTIMATE = SIMILARITY / 100 - 4 * (0.85 * 0.15 / (BANDS * ROWS)) ** 0.5 / (1 - 2.0 ** -BITS)
MULTIPLIERS = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
SIGNATURE = "doc_id long, n long, h1 long, h2 long, bands array<long>, s0 long, s1 long, s2 long, s3 long"


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; A-Z count as a-z."""
    h = word_hashes(text.encode("utf-8", "surrogatepass").lower().split())
    if not len(h):
        return h
    width = min(k, len(h))
    acc = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        acc = (acc ^ (acc >> np.uint64(29))) * STEP + h[j:len(h) - width + 1 + j]
    acc = (acc ^ (acc >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(acc ^ (acc >> np.uint64(32)))


def minima(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """32-bit minima of each set under every multiplier: one row per set."""
    out = np.empty((len(offsets), len(MULTIPLIERS)), np.uint32)
    product = np.empty_like(values)
    for j, m in enumerate(MULTIPLIERS):
        np.multiply(values, m, out=product)
        out[:, j] = np.minimum.reduceat(product, offsets) >> np.uint64(32)
    return out


def bands(low: np.ndarray) -> np.ndarray:
    acc = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(low), BANDS)).copy()
    for r in range(ROWS):
        acc = (acc ^ (acc >> np.uint64(31))) * STEP + low[:, r::ROWS].astype(np.uint64)
    return ((acc ^ (acc >> np.uint64(32))) * STEP).view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """Low two bits of every minimum, 32 to a long."""
    out = np.zeros((len(low), 4), np.uint64)
    for j in range(low.shape[1]):
        out[:, j // 32] |= (low[:, j] & 3).astype(np.uint64) << np.uint64(2 * (j % 32))
    return out.view(np.int64)


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """Set size, 128-bit set hash, band keys and packed bits of every document."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    names = [c.split()[0] for c in SIGNATURE.split(", ")]

    def run(batches):
        for held in chunks(batches, 1 << 20):
            sets = [shingle_set(t, shingle) for _, t in held]
            size = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(size)
            hashes, keys, bits = np.zeros((len(sets), 2), np.int64), np.zeros((len(sets), BANDS), np.int64), np.zeros((len(sets), 4), np.int64)
            if len(full):
                values = np.concatenate([sets[i] for i in full])
                starts = np.concatenate([[0], np.cumsum(size[full])[:-1]])
                low = minima(values, starts)
                keys[full], bits[full] = bands(low), packed(low)
                hashes[full, 0] = np.add.reduceat(values, starts).view(np.int64)
                hashes[full, 1] = np.add.reduceat((values ^ (values >> np.uint64(30))) * STEP, starts).view(np.int64)
            flat = pa.array(keys.ravel())
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in held], pa.int64()), pa.array(size), pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), listed,
                 *(pa.array(bits[:, j]) for j in range(4))], names=names)

    out = texts(docs).mapInArrow(run, SIGNATURE)
    return out.withColumn("doc_id", F.coalesce("doc_id", F.lit(LOWEST)))


def estimate(a: str, b: str) -> Column:
    """Similarity estimate from packed bits: share of equal entries, corrected for matches by chance."""
    unequal = F.lit(0)
    for j in range(4):
        x = F.col(f"{a}.s{j}").bitwiseXOR(F.col(f"{b}.s{j}"))
        pairs = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        unequal = unequal + F.bit_count(pairs)
    chance = 2.0 ** -BITS
    return ((1 - unequal / (BANDS * ROWS)) - chance) / (1 - chance)


def plausible(a: str, b: str) -> Column:
    """Set sizes allow the similarity, and the estimate does not rule it out."""
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (small * 100 >= large * SIMILARITY) & (estimate(a, b) >= ESTIMATE)


def shingle_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """id, set of the documents named in ids."""
    wanted = lookup(ids.distinct())
    rows = texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(LOWEST)))

    def run(batches):
        for held in chunks(batches, 1 << 20):
            sets = [shingle_set(t, shingle).view(np.int64) for _, t in held]
            offsets = np.zeros(len(sets) + 1, np.int32)
            np.cumsum([len(s) for s in sets], out=offsets[1:])
            flat = pa.array(np.concatenate(sets)) if sets else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), flat)],
                                             names=["id", "set"])

    return rows.join(wanted, rows["doc_id"] == wanted["id"], "left_semi").mapInArrow(run, "id long, set array<long>")


def confirmed(docs: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    sets = stage(shingle_sets(docs, ids, shingle))
    both = (pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
            .join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared * 100 >= SIMILARITY * (F.size("sa") + F.size("sb") - shared)).select("a", "b").distinct()


def _across(docs: DataFrame, apart: DataFrame, keys: DataFrame, shingle: int) -> DataFrame:
    """Confirmed pairs (a, b) of one bucket whose components differ.

    Only members with a plausible partner stay, with their sets; the join's own condition then confirms a
    pair, in the first bucket that the two share. So no row is made for a pair that fails.
    """
    meets = lambda x, y: (F.col(f"{x}.bucket") == F.col(f"{y}.bucket")) & (F.col("x.label") < F.col("y.label")) & plausible("x", "y")
    low = stage(apart.alias("x").join(apart.alias("y"), meets("x", "y"), "left_semi"))
    high = stage(apart.alias("y").join(apart.alias("x"), meets("y", "x"), "left_semi"))
    ids = low.select(F.col("rep").alias("id")).unionByName(high.select(F.col("rep").alias("id")))
    sets = stage(shingle_sets(docs, ids, shingle).withColumnRenamed("id", "rep").join(keys, "rep"))
    x, y = low.join(sets, "rep").alias("x"), high.join(sets, "rep").alias("y")
    first = F.element_at(F.array_intersect("x.bands", "y.bands"), 1) == F.col("x.bucket")
    shared = F.size(F.array_intersect("x.set", "y.set"))
    reached = shared * 100 >= SIMILARITY * (F.col("x.n") + F.col("y.n") - shared)
    return x.join(y, meets("x", "y") & first & reached).select(
        F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    rows = stage(signatures(docs, shingle))
    bits = ["n", "s0", "s1", "s2", "s3"]
    classes = stage(rows.where("n > 0").groupBy("h1", "h2").agg(
        F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in [*bits, "bands"]]))
    light = classes.select("rep", *bits)
    placed = classes.select("rep", F.explode("bands").alias("bucket"))
    band_hub = F.min_by("rep", F.xxhash64("rep", "bucket")).alias("hub")
    shared = stage(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), band_hub).where("size > 1").drop("size"))
    members = stage(placed.join(shared, "bucket"))
    first = members.where("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    first = stage(first.join(light.alias("x"), F.col("a") == F.col("x.rep")).join(light.alias("y"), F.col("b") == F.col("y.rep"))
                  .where(plausible("x", "y")).select("a", "b").distinct())
    # Rows of one document with different texts are linked by their id.
    several = rows.where("n > 0").groupBy("doc_id").agg((F.min("h1") < F.max("h1")).alias("several")).where("several")
    own = rows.join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).where("doc_id <> rep")
    twice = own.join(several, "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    edges = stage(confirmed(docs, first, shingle).unionByName(twice))
    reached = stage(components(edges))
    # Members of buckets that still span several components.
    label = F.coalesce("component", "rep").alias("label")
    known = members.join(reached, F.col("rep") == F.col("vertex"), "left").select("bucket", "rep", label)
    mixed = known.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
    apart = stage(known.join(mixed, "bucket").join(light, "rep"))
    more = stage(_across(docs, apart, classes.select("rep", "bands"), shingle))
    if not more.isEmpty():
        reached = stage(components(edges.unionByName(more)))
    labels = classes.select("h1", "h2", "rep").join(reached, F.col("rep") == F.col("vertex"), "left").select(
        "h1", "h2", F.coalesce("component", "rep").alias("component"))
    out = rows.join(labels, ["h1", "h2"], "left").withColumn("component", F.coalesce("component", "doc_id"))
    given = lambda c: F.when(F.col(c) != LOWEST, F.col(c))
    return out.select(given("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), given("component").alias("component_id"),
                      (F.col("doc_id") == F.col("component")).alias("kept"))


def drop_near_copies(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """docs with one document of each group of near copies, all columns kept."""
    gone = near_duplicates(docs, shingle).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_gone"]), "left_anti")
