"""LM scoring by a Katz bigram model with Good-Turing discounts and exactly normalised backoff weights.

    P(w | h) = g(h) d_c c(h, w) / c(h)   if h w was seen,   else   a(h) P(w)
    P(w)     = g d_c c(w) / N            if w was seen,     else   the mass left over (one unknown token)

d_c are Good-Turing discounts for counts up to five (half a count off where the counts of counts allow no
Good-Turing estimate), g leaves at least 1 / (c + 1) to the unseen, and a(h) makes each history sum to one.

The counts live in two tables partitioned by hash: words, and bigrams under their history. Documents are
cut into blocks. A block asks each partition once for the distinct words or bigrams it holds, in one
packed message with its own counts; the partition adds up all messages and answers with totals in the same
order. So no message repeats a key, nothing needs a table in memory as a whole, and a lost task is redone
from its block. A block sends no message to a partition it asks nothing, so messages are never more than the
distinct keys of all blocks. Frequent histories are spread over many partitions by the following word.
The texts are shuffled once, by block, into a table of one file a partition, which all passes read in place;
the table leaves the catalog before the scores are returned.

Defined cases: a null text counts as empty and is the end token alone; a null id is neither dropped nor
held out; without training tokens every token is the unknown one; repeated rows are documents of their own;
no rows give no rows; other columns are not read. A very long text makes its block as long as itself.
"""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waitline.llm.common import texts, word_hashes
from waitline.sources.session import ship_package
from waitline.sources.tables import discard_later, stage, workspace

BLOCK_BYTES = 12 << 20
PARTS = 20_000  # most partitions of the stored texts; beyond, a partition holds several blocks, read one after the other
TOP = 5  # largest discounted count
HOT, SALTS = 256, 64  # histories of over 1/HOT of all tokens are spread over SALTS partitions
END, BEGIN = np.uint64(0x1D872B41A5B1C3E7), np.uint64(0x7A3C55D09F1E6B25)
STEP = np.uint64(0x9E3779B97F4A7C15)
MESSAGE = "block int, bucket int, payload binary"
NUMBERS = "total long, kinds long, " + ", ".join(f"r{i} long" for i in range(1, TOP + 2))
SCORES = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, 5), 1)


def unpack(payload: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(zstandard.decompress(payload))


def planes(a: np.ndarray) -> np.ndarray:
    """Bytes of sorted 64-bit values, place by place, which compresses better."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T)


def from_planes(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a.T).reshape(-1).view(np.uint64)


def discounts(r: list[int]) -> np.ndarray:
    """d_0 .. d_TOP from counts of counts r[0] = n_1 ...; d_0 is not used.

    Counts up to the largest k <= TOP whose Good-Turing estimates all lie between 0 and 1 are discounted.
    """
    for k in range(TOP, 0, -1):
        if min(r[:k + 1]) > 0 and (k + 1) * r[k] < r[0]:
            cut = (k + 1) * r[k] / r[0]
            d = np.array([((c + 1) * r[c] / r[c - 1] / c - cut) / (1 - cut) for c in range(1, k + 1)])
            if (d > 0).all() and (d < 1).all():
                return np.concatenate([[1.0], d, np.ones(TOP - k)])
    return np.array([1.0] + [(c - 0.5) / c for c in range(1, TOP + 1)])


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * np.where(c > TOP, 1.0, d[np.minimum(c, TOP)])


def lost(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Counts taken off by discounting, from n[..., r - 1] items of count r."""
    return (n * np.arange(1, TOP + 1) * (1 - d[1:])).sum(axis=-1)


class Unigrams:
    """Probabilities of single tokens, from totals over the training text."""

    def __init__(self, total: int, kinds: int, r: list[int]):
        self.total, self.kinds, self.d = total, kinds, discounts(r)
        seen = total - float(lost(np.array(r[:TOP]), self.d)) if total else 0.0
        self.g = min(1.0, total * total / (total + 1) / seen) if seen else 1.0
        self.unknown = 1.0 - self.g * seen / total if total else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.g * discounted(c, self.d) / max(1, self.total), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1.0) / (self.total + self.kinds + 1.0))


class Block:
    """Token ids of a block of documents: local numbers into its sorted distinct word hashes."""

    def __init__(self, docs: pa.Table):
        self.ids, self.train = docs["doc_id"].to_pylist(), np.array(docs["train"].to_pylist(), bool)
        parts, end = [], np.array([END], np.uint64)
        for text in docs["text"]:
            parts += [word_hashes(text.as_py().encode("utf-8", "surrogatepass").lower().split()), end]
        self.length = np.array([len(p) + 1 for p in parts[::2]], np.int64)
        tokens = np.concatenate(parts)
        del parts
        self.words, token = np.unique(tokens, return_inverse=True)
        self.token = token.astype(np.int32)
        self.from_train = np.repeat(self.train, self.length)

    def asked(self, buckets: int):
        """(bucket, positions of the words it answers for) of every partition with any."""
        of = (self.words % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        names, starts = np.unique(of[order], return_index=True)
        return zip(names.tolist(), np.split(order, starts[1:]))

    def learn(self, answers: dict[int, bytes], buckets: int) -> None:
        self.count = np.zeros(len(self.words), np.int64)
        for bucket, at in self.asked(buckets):
            self.count[at] = unpack(answers[bucket])[0]

    def pair(self, total: int, begins: int, buckets: int) -> None:
        """Distinct bigrams, under group keys (history, and for a frequent one a salt from the word)."""
        n = len(self.words) + 1
        number = np.empty(len(self.token), np.int64)
        number[1:] = self.token[:-1]
        number[np.concatenate([[0], np.cumsum(self.length)[:-1]])] = n - 1
        number *= n
        number += self.token
        keys, bigram = np.unique(number, return_inverse=True)
        self.bigram = bigram.astype(np.int32)
        del number, bigram
        self.times = np.bincount(self.bigram, weights=self.from_train, minlength=len(keys)).astype(np.int64)
        self.h, self.w = keys // n, keys % n
        self.h_count = np.append(self.count, begins)
        hot = self.h_count * HOT > max(total, 1)
        salt = np.where(hot[self.h], (self.words[self.w] >> np.uint64(40)).astype(np.int64) % SALTS, 0)
        # Groups asked for: each history once, a hot one under every salt, whether or not a word falls there.
        present = np.unique(self.h)
        groups = np.concatenate([present[~hot[present]] * SALTS, (present[hot[present]][:, None] * SALTS + np.arange(SALTS)).ravel()])
        self.groups = np.sort(groups)
        self.group = np.searchsorted(self.groups, self.h * SALTS + salt)
        named = np.append(self.words, BEGIN)[self.groups // SALTS]
        key = (named ^ ((self.groups % SALTS).astype(np.uint64) * STEP)) * STEP
        self.key = key ^ (key >> np.uint64(29))
        self.bucket = (self.key % np.uint64(buckets)).astype(np.int64)

    def requests(self):
        """(bucket, groups, bigrams) by position, in the order messages are written and answered; no bucket without groups."""
        by_group = np.argsort(self.bucket, kind="stable")
        names, starts = np.unique(self.bucket[by_group], return_index=True)
        own = self.bucket[self.group]
        by_pair = np.lexsort((self.group, own))
        return zip(names.tolist(), np.split(by_group, starts[1:]), np.split(by_pair, np.searchsorted(own[by_pair], names[1:])))


def message(block: int, bucket: int, payload: bytes) -> dict:
    return {"block": block, "bucket": bucket, "payload": payload}


MESSAGE_SCHEMA = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())])
ANSWER_SCHEMA = pa.schema([*MESSAGE_SCHEMA, *((c.split()[0], pa.int64()) for c in NUMBERS.split(", "))])


def numbers(c: np.ndarray) -> dict:
    return {"block": -1, "total": int(c.sum()), "kinds": int((c > 0).sum()), **{f"r{i}": int((c == i).sum()) for i in range(1, TOP + 2)}}


def score_documents(docs: DataFrame, train: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score. train: which rows the model learns from."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = texts(docs.withColumn("_train", F.coalesce(train, F.lit(True))), "_train").withColumnRenamed("_train", "train")
    size, begins = rows.agg(F.sum(F.octet_length("text") + 1), F.count_if("train")).first()
    blocks = max(1, -(-(size or 0) // block_bytes))
    buckets = max(1, (blocks + 1) // 2)
    # Bucketed by block, so that the three passes over the texts need no shuffle of them. Each task of the
    # one shuffle before holds one bucket and writes one file.
    parts = min(blocks, PARTS)
    name = f"katz_{uuid.uuid4().hex}"
    placed = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(blocks)).cast("int"))
    folder = workspace(spark)
    (placed.repartition(parts, "block").write.bucketBy(parts, "block").option("path", folder).option("compression", "zstd")
     .saveAsTable(name))
    discard_later(spark, folder)
    table = spark.table(name)

    def ask_words(key, held):
        b = Block(held)
        own = np.bincount(b.token, weights=b.from_train, minlength=len(b.words)).astype(np.uint32)
        out = [message(key[0].as_py(), k, pack(planes(b.words[at]), own[at])) for k, at in b.asked(buckets)]
        return pa.Table.from_pylist(out, MESSAGE_SCHEMA)

    def answer_words(key, held):
        asked = [unpack(x.as_py()) for x in held["payload"]]
        words = [from_planes(w) for w, _ in asked]
        _, at = np.unique(np.concatenate(words), return_inverse=True)
        c = np.bincount(at, weights=np.concatenate([n for _, n in asked])).astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        out = [message(block.as_py(), key[0].as_py(), pack(c[part]))
               for block, part in zip(held["block"], np.split(at, ends[:-1]))]
        return pa.Table.from_pylist([*out, numbers(c)], ANSWER_SCHEMA)

    words = stage(table.groupBy("block").applyInArrow(ask_words, MESSAGE).groupBy("bucket").applyInArrow(answer_words, f"{MESSAGE}, {NUMBERS}"))
    base = Unigrams(*totals(words))

    def known(docs_: pa.Table, answers: pa.Table) -> tuple[Block, dict]:
        b = Block(docs_)
        of = {(kind, k): p for kind, k, p in zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers["payload"].to_pylist())}
        b.learn({k: p for (kind, k), p in of.items() if kind == 1}, buckets)
        b.pair(base.total, begins, buckets)
        return b, {k: p for (kind, k), p in of.items() if kind == 2}

    def ask_bigrams(key, docs_, answers):
        if not docs_.num_rows:
            return MESSAGE_SCHEMA.empty_table()
        b, _ = known(docs_, answers)
        out = []
        for k, groups, pairs in b.requests():
            place = np.searchsorted(groups, b.group[pairs])  # groups of a bucket are in rising order
            used, word = np.unique(b.w[pairs], return_inverse=True)
            out.append(message(key[0].as_py(), k, pack(
                b.key[groups], np.bincount(place, minlength=len(groups)).astype(np.uint32), planes(b.words[used]),
                b.count[used], word.astype(np.uint32), b.times[pairs].astype(np.uint32))))
        return pa.Table.from_pylist(out, MESSAGE_SCHEMA)

    def answer_bigrams(key, held):
        asked = [unpack(x.as_py()) for x in held["payload"]]
        keys, group = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        words, word = np.unique(np.concatenate([from_planes(a[2]) for a in asked]), return_inverse=True)
        count = np.zeros(len(words), np.int64)
        count[word] = np.concatenate([a[3] for a in asked])
        ends, word_ends, pairs = (np.cumsum([len(a[k]) if k != 2 else a[k].shape[1] for a in asked]) for k in (0, 2, 4))
        # One number for a bigram: its group and word among those of this partition.
        number = np.empty(pairs[-1], np.int64)
        times = np.empty(pairs[-1], np.uint32)
        for i, (a, g, w) in enumerate(zip(asked, np.split(group, ends[:-1]), np.split(word, word_ends[:-1]))):
            part = slice(pairs[i] - len(a[4]), pairs[i])
            number[part] = np.repeat(g, a[1]) * len(words) + w[a[4]]
            times[part] = a[5]
        del asked, a, word
        found, at = np.unique(number, return_inverse=True)
        del number
        at = at.astype(np.int32)
        c = np.bincount(at, weights=times, minlength=len(found)).astype(np.int64)
        owner, p = found // len(words), base.p(count[found % len(words)]) if len(found) else np.zeros(0)
        low = np.stack([np.bincount(owner[c == r], minlength=len(keys)) for r in range(1, TOP + 1)], axis=1).astype(np.uint32)
        mass = np.bincount(owner[c > 0], weights=p[c > 0], minlength=len(keys))
        out = [message(block.as_py(), key[0].as_py(), pack(c[part].astype(np.uint32), low[g], mass[g]))
               for block, part, g in zip(held["block"], np.split(at, pairs[:-1]), np.split(group, ends[:-1]))]
        return pa.Table.from_pylist([*out, numbers(c)], ANSWER_SCHEMA)

    first = words.where("block >= 0").select("block", F.lit(1).alias("kind"), "bucket", "payload")
    asks = table.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(ask_bigrams, MESSAGE)
    bigrams = stage(asks.groupBy("bucket").applyInArrow(answer_bigrams, f"{MESSAGE}, {NUMBERS}"))
    d = discounts(totals(bigrams)[2])

    def evaluate(key, docs_, answers):
        if not docs_.num_rows:
            return pa.Table.from_arrays([[]] * 6, names=[c.split()[0] for c in SCORES.split(", ")])
        b, found = known(docs_, answers)
        c = np.zeros(len(b.h), np.int64)
        low, mass = np.zeros((len(b.groups), TOP)), np.zeros(len(b.groups))
        for k, groups, pairs in b.requests():
            c[pairs], low[groups], mass[groups] = unpack(found[k])
        # Parts of a spread history add up.
        n = len(b.words) + 1
        whole = b.groups // SALTS
        fewer = np.stack([np.bincount(whole, weights=low[:, r], minlength=n) for r in range(TOP)], axis=1)
        covered = np.bincount(whole, weights=mass, minlength=n)
        # A history's count is that of the word itself, but the end token opens nothing.
        begins_ = b.h_count.astype(float)
        seen = begins_ - lost(fewer, d)
        g = np.where(seen > 0, np.minimum(1.0, begins_ * begins_ / (begins_ + 1) / np.maximum(seen, 1e-300)), 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where(begins_ > 0, (1 - g * seen / np.maximum(begins_, 1)) / (1 - covered), 1.0)
            unigram = base.p(b.count)
            p = np.where(c > 0, g[b.h] * discounted(c, d) / np.maximum(begins_[b.h], 1), left[b.h] * unigram[b.w])
        starts = np.concatenate([[0], np.cumsum(b.length)[:-1]])
        add = lambda x: np.add.reduceat(x, starts)
        return pa.table({
            "doc_id": pa.array(b.ids, pa.int64()), "train": b.train, "n_tokens": b.length,
            "n_known": add((b.count > 0).astype(np.int64)[b.token]), "base_score": add(base.base(b.count)[b.token]),
            "score": add(np.log10(p)[b.bigram])})

    second = bigrams.where("block >= 0").select("block", F.lit(2).alias("kind"), "bucket", "payload")
    answers = first.unionByName(second)
    scored = stage(table.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(evaluate, SCORES))
    spark.sql(f"DROP TABLE {name}")
    return scored.withColumn("train_tokens", F.lit(base.total).cast("long"))


def totals(answers: DataFrame) -> tuple[int, int, list[int]]:
    """Tokens, kinds and counts of counts over all partitions: one row."""
    names = [c.split()[0] for c in NUMBERS.split(", ")]
    row = answers.where("block < 0").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    return row["total"], row["kinds"], [row[c] for c in names[2:]]
