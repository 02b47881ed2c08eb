"""Spelling variant grouping by sorted-list dynamic programming.

Words that differ by one inserted, deleted or replaced code point are near. Two near words share all that
stands before their first difference and all that stands after it. So words are dealt into lists: with the
same beginning (a difference in the second half) and with the same end (a difference in the first half),
each list holding words of one length and of the next one. A pair meets in one list only, that of its first
difference and its shorter length.

A list is sorted. A word's edit matrix against all words of the list is scanned along the sorted order: words
that share a prefix share the matrix rows of that prefix, so a row is computed once per run of equal
prefixes (runs are read off the longest common prefixes of neighbours), a row is the three cells within one
edit of the diagonal, and a run whose row exceeds one edit in every cell is skipped as a whole. The scan
takes a step for all words of many lists at once.

A list longer than `limit` is dealt anew by halves of its half, down to single positions, where lists are no
longer than the alphabet; nothing is dropped.

A word's form is its near word with the most occurrences (then the first in code-point order), if these are
`ratio` times its own; its root is where forms lead. Occurrences grow tenfold with each step, so the number
of steps follows from the largest count, and roots are found by pointer doubling.

Defined cases: a null or empty text has no words; a null id counts as no digits in the hash; a run repeated
in a document has the same hash each time and counts each time; ties go to the smaller word; repeated
rows count as often as they occur; a very long text or run is read whole; no rows give no rows; other columns
are not read.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waitline.sources.session import ship_package
from waitline.sources.tables import stage

LEAST_LENGTH, LEAST_COUNT, RATIO, EVERY = 7, 2, 10, 31
LIMIT = 200_000
CELLS, LANES = 2_000_000, 40_000


def runs(docs: DataFrame, least: int = LEAST_LENGTH, every: int = EVERY) -> DataFrame:
    """`word` of every run of letters long enough, lower-cased A-Z only; one run in `every` by hash lost a code point."""
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                        F.explode(F.regexp_extract_all("text", F.lit(f"([A-Za-z\\u00C0-\\u00FF]{{{least},}})"), F.lit(1))).alias("run"))
    run = F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
    hashed = found.select(run.alias("run"), F.crc32(F.concat("id", F.lit(":"), run).cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """word and n of the words that occur often enough, counted before the shuffle."""
    return (runs(docs, least, every).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where((F.length("word") >= least) & (F.col("n") >= count)))


# Lists ---------------------------------------------------------------------------------------

def _dealt(words: DataFrame, cls: Column, part: Column, parts: int) -> DataFrame:
    """Rows (key, cls, part, low, high, word, n): the list of each word for a class and a part of the positions.

    A class holds words of length cls and cls + 1; its first differences from low on and before high.
    """
    low, high = F.floor(cls * part / parts).cast("int"), F.floor(cls * (part + 1) / parts).cast("int")
    last = part == parts - 1
    end = F.when(last, F.lit("")).otherwise(F.substring("word", F.length("word") - (cls - high) + 1, F.length("word")))
    key = F.xxhash64(cls, part, F.substring("word", F.lit(1), low), end)
    return (words.select(key.alias("key"), cls.alias("cls"), part.alias("part"), low.alias("low"),
                         F.when(last, cls + 1).otherwise(high).alias("high"), "word", "n").where("low < high"))


def lists(words: DataFrame, least: int, limit: int, n_words: int, longest: int) -> list[DataFrame]:
    """All lists, none longer than limit unless its words differ in one position only."""
    size = F.length("word")
    spread = words.withColumn("cls", F.explode(F.array(size, size - 1))).where(F.col("cls") >= least)
    spread = spread.withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
    parts, out, rows = 2, [], _dealt(spread, F.col("cls"), F.col("part"), 2)
    while n_words > limit and parts <= longest:  # fewer words than the limit cannot make a longer list
        crowded = stage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > limit).select("key"))
        if crowded.isEmpty():
            break
        out.append(rows.join(crowded, "key", "left_anti"))
        again = rows.join(crowded, "key", "left_semi").withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
        parts *= 2
        rows = _dealt(again.withColumn("part", F.col("part") * 2 + F.col("half")), F.col("cls"), F.col("part"), parts)
    return [*out, rows]


# The scan ------------------------------------------------------------------------------------

def scan(first: np.ndarray, words: list[str], cls: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (word, near word) as indices, within sorted lists that lie one behind the other. first: where a list begins."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    width = int(lengths.max()) + 2
    codes = np.frombuffer("".join([w.ljust(width, "\0") for w in words]).encode("utf-32-le"), np.uint32).reshape(len(words), width)
    shared = np.full(len(words), -1, np.int64)
    shared[1:] = (codes[1:] != codes[:-1]).argmax(axis=1)
    shared[first] = -1
    runs_at = np.flatnonzero(first)
    list_of = np.cumsum(first) - 1
    pairs = []
    for begin in range(0, len(words), LANES):
        query = np.arange(begin, min(begin + LANES, len(words)))
        starts, node = runs_at, list_of[query]
        band = np.tile(np.array([2, 0, 1], np.int8), (len(query), 1))  # cells d-1, d, d+1 of row d
        for d in range(width - 1):
            # Runs of words that share d + 1 characters, and those within each run that shares d.
            below = np.flatnonzero(shared <= d)
            edges = np.searchsorted(below, np.append(starts, len(words)))
            many = edges[node + 1] - edges[node]
            lane = np.repeat(np.arange(len(query)), many)
            node = np.arange(len(lane)) - np.repeat(np.cumsum(many) - many, many) + edges[node][lane]
            query, band = query[lane], band[lane]
            head = below[node]
            sign = codes[head, d]
            over = sign == 0
            if over.any():
                gap = lengths[query] - d
                hit = over & (np.abs(gap) <= 1)
                hit[hit] = band[hit, gap[hit] + 1] == 1
                hit[hit] = np.minimum(lengths[query[hit]], d) == cls[query[hit]]
                pairs.append((query[hit], head[hit]))
            before = codes[query, d - 1] != sign if d else np.ones(len(query), bool)
            here, after = codes[query, d] != sign, codes[query, d + 1] != sign
            new = np.empty_like(band)
            new[:, 0] = np.minimum(band[:, 1] + 1, band[:, 0] + before)
            new[:, 1] = np.minimum(np.minimum(band[:, 1] + here, band[:, 2] + 1), new[:, 0] + 1)
            new[:, 2] = np.minimum(band[:, 2] + after, new[:, 1] + 1)
            alike = new[:, 1] == 0
            # The first difference lies from low on and before high.
            keep = ~over & (new.min(axis=1) <= 1) & np.where(d < low[query], alike, ~alike | (d + 1 < high[query]))
            query, node, band, starts = query[keep], node[keep], new[keep], below
            if not len(query):
                break
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*pairs)) or (np.zeros(0, np.int64),) * 2


def best(pairs: tuple[np.ndarray, np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words that have near ones, how many, and the near one with most occurrences (ties: the first)."""
    query, near = pairs
    order = np.lexsort((near, -n[near], query))
    query, near = query[order], near[order]
    lead = np.flatnonzero(np.diff(query, prepend=-1))
    return query[lead], np.diff(np.append(lead, len(query))), near[lead]


NEAR = "word string, n_near long, near_n long, near string"


def _scanned(batches):
    """Whole lists out of sorted batches, many at a time; lists of one word are passed over."""
    held, cells = [], 0

    def flush(rows: pa.Table):
        key = rows["key"].to_numpy()
        cls, low, high, n = (rows[c].to_numpy() for c in ("cls", "low", "high", "n"))
        new = np.append(True, (np.diff(key) != 0) | (np.diff(cls) != 0) | (np.diff(low) != 0))
        alone = new & np.append(new[1:], True)
        rows, cls, low, high, n, new = rows.filter(pa.array(~alone)), cls[~alone], low[~alone], high[~alone], n[~alone], new[~alone]
        if not len(n):
            return None
        words = rows["word"].to_pylist()
        at, count, near = best(scan(new, words, cls, low, high), n)
        return pa.RecordBatch.from_arrays(
            [pa.array([words[i] for i in at], pa.string()), pa.array(count, pa.int64()), pa.array(n[near], pa.int64()),
             pa.array([words[i] for i in near], pa.string())], names=["word", "n_near", "near_n", "near"])

    for b in batches:
        if not b.num_rows:
            continue
        key = b["key"].to_numpy()
        ends = np.flatnonzero(np.diff(key)) + 1
        # A list is not cut: what is held goes once the next list begins.
        for low, high in zip([0, *ends], [*ends, b.num_rows]):
            if held and cells > CELLS and held[-1]["key"][-1].as_py() != key[low]:
                if (out := flush(pa.Table.from_batches(held))) is not None:
                    yield out
                held, cells = [], 0
            held.append(b.slice(low, high - low))
            cells += (high - low) * (int(b["cls"][low].as_py()) + 3)
    if held and (out := flush(pa.Table.from_batches(held))) is not None:
        yield out


def near_words(words: DataFrame, least: int = LEAST_LENGTH, limit: int = LIMIT) -> DataFrame:
    """word, n_near, near_n and near (its most frequent near word) of the words (word, n) that have near ones."""
    ship_package(words.sparkSession)
    n_words, longest = words.agg(F.count(F.lit(1)), F.max(F.length("word"))).first()
    found = None
    for rows in lists(words, least, limit, n_words, longest or 0):
        part = rows.repartition("key").sortWithinPartitions("key", "cls", "low", "word").drop("part").mapInArrow(_scanned, NEAR)
        found = part if found is None else found.unionByName(part)
    top = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("top")).select(
        "word", "n_near", (-F.col("top.n")).alias("near_n"), F.col("top.word").alias("near"))


def roots(forms: DataFrame, most: int) -> DataFrame:
    """word and root from (word, form): forms followed to the last. most: the largest count of any word."""
    hop = stage(forms.select("word", F.col("form").alias("root")))
    steps = math.floor(math.log10(max(most, LEAST_COUNT) / LEAST_COUNT) + 1e-9)
    for _ in range(math.ceil(math.log2(max(1, steps)))):
        onward = hop.select(F.col("word").alias("root"), F.col("root").alias("further"))
        hop = stage(hop.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return hop


def spelling_variants(docs: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT, ratio: int = RATIO,
                      every: int = EVERY, limit: int = LIMIT) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents."""
    words = stage(vocabulary(docs, least, count, every))
    near = stage(near_words(words, least, limit))
    joined = stage(words.join(near, "word", "left").withColumn("is_form", F.col("near_n") >= ratio * F.col("n")).select(
        "word", F.when(F.col("is_form"), F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("is_form"), F.col("near_n")).alias("form_n")))
    most = words.agg(F.max("n")).first()[0] or 0
    ends = roots(joined.where("form is not null"), most)
    return joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
