"""Mixing sources to target weights by min-cost flow.

Documents are first added up by membership pattern (the set of sources that list them). The flow
network has one node per pattern and one per source: words run from patterns to source quotas, and each
further repetition of a pattern costs more (0, 1, 3 a word), so repeats are used only where a quota needs
them. The network falls apart into connected components of patterns and sources; each is solved by itself, in
one task, any number of them side by side. The flow says how many words each pattern gives to each source;
documents are chosen for it in seeded order.

Defined cases: a null text has size 0 and takes 0; a null source is a source of its own, last in order;
rows that repeat an id are documents of their own with the same place in the seeded order (ties by text
hash and size); a document that no source lists takes 0; a very long text is only counted; no rows give no rows; other columns pass through `materialise` untouched, whatever their names.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waitline.llm.common import offsets, word_count
from waitline.llm.components import components
from waitline.sources.session import ship_package
from waitline.sources.tables import lookup, stage

WEIGHTS = (5, 2, 1)
CAP = 3
COSTS = (0, 1, 3)
SEED = 20
#: The targets of so many sources are found on the driver, of more by joins.
NODES = 20_000


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, cap: int = CAP) -> dict[str | None, float]:
    """Target of each source: shares by weight of all words, held to cap times the source's size.

    What is cut from a source is shared among the others by weight, until none is above.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, open_, out = float(sum(size.values())), set(size), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > cap * size[s]}
        if not full:
            out.update({s: left * weight[s] / total for s in open_})
            break
        for s in full:
            out[s] = float(cap * size[s])
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, size, target and place (in order) of every row of sizes; the targets of `targets`, for any number of sources."""
    spark = sizes.sparkSession
    sizes = stage(sizes)
    schema = "source string, size long, target double, place long"
    few = sizes.limit(NODES + 1).collect()
    if len(few) <= NODES:
        goal = targets([(r["source"], r["size"]) for r in few], weights, cap)
        order = sorted(few, key=lambda r: (r["source"] is None, r["source"] or ""))
        return spark.createDataFrame([(r["source"], r["size"], goal[r["source"]], i) for i, r in enumerate(order)], schema)
    by = F.col("source").asc_nulls_last()
    parts = stage(sizes.repartitionByRange(by).withColumn("part", F.spark_partition_id()))
    before = offsets(parts.groupBy("part").agg(F.count(F.lit(1)).alias("rows")), "part", "rows")
    place = F.col("offset") + F.row_number().over(Window.partitionBy("part").orderBy(by)) - 1
    rows = parts.join(F.broadcast(before), "part").withColumn("place", place.cast("long"))  # one row per partition
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = stage(rows.select("source", "size", "place", weight.alias("weight")))
    words, shares, n = rows.agg(F.sum("size"), F.sum("weight"), F.count(F.lit(1))).first()
    # The level (left / total) only rises from round to round, so each round's full sources hold those of the last.
    left, total, held = words, shares, 0
    while True:
        share = F.lit(float(left)) * F.col("weight") / F.lit(total)
        full = share > cap * F.col("size")
        cut, gone, count = rows.where(full).agg(F.sum("size"), F.sum("weight"), F.count(F.lit(1))).first()
        if count == held:
            break
        if count == n:
            full = F.lit(True)
            break
        left, total, held = words - cap * cut, shares - gone, count
    goal = F.when(full, (cap * F.col("size")).cast("double")).otherwise(share)
    return stage(rows.select("source", "size", goal.alias("target"), "place"))


def min_cost_flow(supply: dict, quota: dict, members: dict, costs=COSTS) -> dict:
    """Words from each pattern to each source: {(pattern, source): words}.

    Successive cheapest paths. A pattern may give its words once for each entry of costs, at that
    price a word; members names the sources of a pattern. Sizes are whole numbers.
    """
    start, end = ("start",), ("end",)
    edges: list[list] = []
    at: dict = {}

    def arc(a, b, capacity, cost):
        at.setdefault(a, []).append(len(edges))
        edges.append([b, capacity, cost])
        at.setdefault(b, []).append(len(edges))
        edges.append([a, 0, -cost])
        return len(edges) - 2

    for p, words in supply.items():
        for cost in costs:
            arc(start, ("p", p), words, cost)
    between = {(p, s): arc(("p", p), ("s", s), len(costs) * supply[p], 0) for p in supply for s in members[p] if s in quota}
    for s, words in quota.items():
        arc(("s", s), end, words, 0)
    while True:
        best, via, queue, waiting = {start: 0}, {}, deque([start]), {start}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for k in at.get(a, ()):
                b, capacity, cost = edges[k]
                if capacity > 0 and best[a] + cost < best.get(b, 1 << 60):
                    best[b], via[b] = best[a] + cost, k
                    if b not in waiting:
                        waiting.add(b)
                        queue.append(b)
        if end not in best:
            break
        path, node = [], end
        while node != start:
            path.append(via[node])
            node = edges[via[node] ^ 1][0]
        flow = min(edges[k][1] for k in path)
        for k in path:
            edges[k][1] -= flow
            edges[k ^ 1][1] += flow
    return {key: edges[k ^ 1][1] for key, k in between.items() if edges[k ^ 1][1]}


def mix(docs: DataFrame, sources: Column | None = None, seed: int = SEED, weights=WEIGHTS, cap: int = CAP,
        whole: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every document; with whole, also its row as struct `doc`.

    sources: array of the sources that list a document (default: its own one). source_size and target
    are sums over these.
    """
    spark = docs.sparkSession
    listed = F.array_sort(F.array_distinct(F.array("source") if sources is None else sources))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(word_count(F.col("text")), F.lit(0)).cast("long").alias("size"),
        listed.alias("sources"), F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")).alias("rank"),
        F.xxhash64("text").alias("tie"), *([F.struct("*").alias("doc")] if whole else []))
    lean = stage(rows.drop("doc"))
    found = stage(lean.groupBy("sources").agg(F.sum("size").alias("words")).withColumn("pattern", F.monotonically_increasing_id()))
    quota = lookup(_plan(found, weights, cap))
    lean = lean.join(quota, F.col("sources").eqNullSafe(F.col("of")))
    outer = _edges(lean, F.shiftright("rank", 52), F.lit(0))
    # Inside the range where a pattern's rest runs out, the next 12 bits cut again.
    near = lean.join(outer, "pattern").where(F.shiftright("rank", 52) == F.col("edge")).drop("edge")
    inner = _edges(near, F.shiftright("rank", 40), F.col("filled"))
    base = rows.join(quota, F.col("sources").eqNullSafe(F.col("of"))) if whole else lean
    return _choose(base, inner)


def _node(source: Column) -> Column:
    """A source's name in the network; the null source has one too."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


PLAN = "pattern long, rounds long, rest long, source_size long, target double"


def _plan(found: DataFrame, weights, cap: int) -> DataFrame:
    """Rounds and rest of every pattern (`of`), with the sizes and targets of its sources.

    Patterns and sources form a graph; each connected component is a network of its own, solved in one task. A
    source that shares no document with another is the smallest component.
    """
    goals = source_targets(found.select(F.explode("sources").alias("source"), "words").groupBy("source").agg(
        F.sum("words").alias("size")), weights, cap)
    goals = goals.select(_node(F.col("source")).alias("node"), "size", "target")
    each = found.select("pattern", "words", F.explode("sources").alias("source")).withColumn("node", _node(F.col("source"))).drop("source")
    many = found.where(F.size("sources") > 1)
    if many.isEmpty():
        each = each.withColumn("component", F.col("node"))
    else:
        rest = F.explode(F.slice("sources", F.lit(2), F.size("sources") - 1))
        joined = components(many.select(F.element_at("sources", 1).alias("x"), rest.alias("y")).select(
            _node(F.col("x")).alias("a"), _node(F.col("y")).alias("b")))
        each = each.join(joined.withColumnRenamed("vertex", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    net = each.join(goals, "node").groupBy("component").agg(F.collect_list(F.struct("pattern", "words", "node", "size", "target")).alias("links"))
    ship_package(found.sparkSession)
    costs = COSTS[:cap]

    def solve(batches):
        for b in batches:
            rows = [r for links in b["links"] for r in _solved(links.as_py(), costs)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(
                [(n, pa.float64() if n == "target" else pa.int64()) for n in ("pattern", "rounds", "rest", "source_size", "target")]))

    plan = net.select("links").mapInArrow(solve, PLAN)
    none = found.where(F.coalesce(F.size("sources"), F.lit(0)) <= 0).selectExpr(
        "pattern", "0L AS rounds", "0L AS rest", "0L AS source_size", "0.0D AS target")
    return plan.unionByName(none).join(found.select("pattern", F.col("sources").alias("of")), "pattern")


def _solved(links: list[dict], costs) -> list[dict]:
    """What the flow of one component gives each pattern. The order of patterns and sources follows from their names alone."""
    words, members, goal = {}, {}, {}
    for x in links:
        words[x["pattern"]] = x["words"]
        members.setdefault(x["pattern"], []).append(x["node"])
        goal[x["node"]] = (x["size"], x["target"])
    order = sorted(members, key=lambda k: sorted(members[k]))
    flow = min_cost_flow({k: words[k] for k in order}, {s: round(goal[s][1]) for s in sorted(goal)},
                         {k: sorted(members[k]) for k in order}, costs)
    given = dict.fromkeys(order, 0)
    for (k, _), n in flow.items():
        given[k] += n
    return [{"pattern": k, "rounds": given[k] // words[k] if words[k] else 0, "rest": given[k] % words[k] if words[k] else 0,
             "source_size": sum(goal[s][0] for s in members[k]), "target": float(sum(goal[s][1] for s in members[k]))} for k in order]


def _edges(rows: DataFrame, bucket: Column, filled: Column) -> DataFrame:
    """Per pattern, the range of the seeded order in which its rest runs out, and the words before it."""
    sums = rows.groupBy("pattern", bucket.alias("bucket")).agg(
        F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first(filled).alias("start"))
    upto = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.col("start") + F.coalesce(F.sum("words").over(upto), F.lit(0)))
    cut = sums.where("before < rest and before + words >= rest")
    return lookup(cut.select("pattern", F.col("bucket").alias("edge"), F.col("before").alias("filled")))


def _choose(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Words each document gives: whole rounds of all, and the rest from the beginning of the seeded order.

    Only the narrow range in which a pattern's rest runs out is ordered document by document; the last
    one there gives just the words still missing.
    """
    bucket = F.shiftright("rank", 40)
    rows = rows.join(edges, "pattern", "left")
    before = F.when(bucket < F.col("edge"), F.col("size")).otherwise(0)
    outside = rows.where(F.col("edge").isNull() | (bucket != F.col("edge"))).withColumn("extra", before.cast("long"))
    w = Window.partitionBy("pattern").orderBy("rank", "doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("filled") + F.coalesce(F.sum("size").over(w), F.lit(0))
    inside = rows.where(bucket == F.col("edge")).withColumn("ahead", ahead).withColumn(
        "extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("ahead"))).cast("long")).drop("ahead")
    taken = F.col("rounds") * F.col("size") + F.col("extra")
    copies = F.when(F.col("size") > 0, F.ceil(taken / F.col("size"))).otherwise(0).cast("int")
    out = outside.unionByName(inside)
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), copies.alias("copies"),
                      *(["doc"] if "doc" in rows.columns else []))


def materialise(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with whole texts and the columns of docs."""
    mixed = mix(docs, whole=True, **options).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
