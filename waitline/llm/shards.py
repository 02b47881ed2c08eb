"""Token-ID output in training order: every sequence has a slot from a keyed permutation, shards have a fixed stride.

Documents in the order of the table's files, and within a file of its rows, form one token stream, an end mark
after each, however the files are split among tasks (a table that is no file is taken in the order of its
partitions); the stream is cut into sequences of equal length. Sequence i goes to slot permute(i), a Feistel network over the next
even power of two that walks its cycle until it lands below the number of sequences. Shard k holds slots
k * per_shard and following, each at a fixed byte offset, so a reader that stopped at any slot seeks and goes on.

The stream is never in one place. Each scan task stores its tokens with their place in the split they were
read from, which fixes the order for good; the token counts of the splits give each its offset; pieces of sequences go packed
to the shard they belong to, and a shard's task writes its file under a name of its own and renames it, so
a task that is run again leaves one complete file.

Defined cases: a null text counts as empty and gives its end mark; a null id stays null; repeated rows are
documents of their own, each in its place; a very long text is encoded whole, in memory of some ten times its
size; the last sequence is filled with end marks; no rows give no rows and no files; other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waitline.llm.common import texts
from waitline.sources.session import ship_package
from waitline.sources.tables import lookup, stage, workspace

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how byte-level BPE parts a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LENGTH, PER_SHARD, KEY, ROUNDS = 2048, 8192, 0x5DEECE66D, 6
UNIT_TOKENS = 1 << 20
ROWS = ("slot long, sequence long, shard int, byte_offset long, n_tokens int, sha256 string, doc_ids array<long>, starts array<int>")

UNIT = pa.schema([("file", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()),
                  ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))])
_LISTS = ("slots", "sequences", "places", "sizes", "doc_ids", "doc_slots", "starts")
PIECES = pa.schema([("shard", pa.int64()), ("tokens", pa.binary()), *((c, pa.list_(pa.int64())) for c in _LISTS)])
PIECE_ROWS = "shard long, tokens binary, " + ", ".join(f"{c} array<long>" for c in _LISTS)


class Encoder:
    """Byte-level BPE ids as 16-bit values; end is the first free id."""

    def __init__(self, vocabulary: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.inner = tiktoken.Encoding("stream", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = len(ranks)

    def encode(self, text: str) -> bytes:
        return np.array(self.inner.encode_ordinary(text), np.uint16).tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        return self.inner.decode_bytes(ids.tolist())


_loaded: dict[int, Encoder] = {}


def encoder(vocabulary: bytes) -> Encoder:
    key = zlib.crc32(vocabulary)
    if key not in _loaded:
        _loaded[key] = Encoder(vocabulary)
    return _loaded[key]


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _feistel(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for k in keys:
        left, right = right, left ^ (_mix(right, k) & mask)
    return (right << np.uint64(half)) | left


def permute(index: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """Slot of each index below n (or with inverse the index of each slot): a keyed permutation of 0 .. n - 1."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    keys = [key * (r + 1) + 0x632BE59BD9B4E019 * r for r in range(ROUNDS)]
    keys = keys[::-1] if inverse else keys
    out = np.asarray(index, np.uint64).copy()
    todo = np.ones(len(out), bool)
    while todo.any():
        out[todo] = _feistel(out[todo], half, keys)
        todo = out >= n
    return out.astype(np.int64)


def _open(folder: str):
    return pa.fs.FileSystem.from_uri(folder)


def shard_name(k: int) -> str:
    return f"shard-{k:08d}.bin"


def write_shards(docs: DataFrame, folder: str | None = None, length: int = LENGTH, per_shard: int = PER_SHARD,
                 key: int = KEY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Write the shards below folder (default: a new one in the shared folder) when the result is computed.

    One row per sequence: slot, sequence (place in the stream), shard, byte_offset, n_tokens (without
    filling), sha256 of its bytes, the doc_ids that start in it with their places, and the folder of the shards.
    """
    spark = docs.sparkSession
    ship_package(spark)
    folder = folder or f"{workspace(spark)}/shards"
    with open(vocabulary, "rb") as f:
        words = spark.sparkContext.broadcast(f.read())

    def tokenise(batches):
        e = encoder(words.value)
        part, place, held_ids, starts, parts, n, split = TaskContext.get().partitionId(), 0, [], [], [], 0, ("", -1)

        def unit():
            packed = zstandard.compress(b"".join(parts), 6)
            return pa.RecordBatch.from_pylist([{"file": split[0], "block": split[1], "part": part, "place": place, "n": n, "tokens": packed,
                                                "doc_ids": held_ids, "starts": starts}], UNIT)

        for batch in batches:
            for key_, text, file, block in zip(batch["doc_id"].to_pylist(), batch["text"], batch["file"].to_pylist(), batch["block"].to_pylist()):
                if (file, block) != split:
                    if n:
                        yield unit()
                    place, held_ids, starts, parts, n, split = 0, [], [], [], 0, (file, block)
                ids = e.encode(text.as_py()) + np.uint16(e.end).tobytes()
                held_ids.append(key_)
                starts.append(n)
                parts.append(ids)
                n += len(ids) // 2
                if n >= UNIT_TOKENS:
                    yield unit()
                    place, held_ids, starts, parts, n = place + n, [], [], [], 0
        if n:
            yield unit()

    # Where a row was read from: the same for any way of splitting files, but for the block within a file, which keeps their order.
    read = texts(docs).withColumn("file", F.input_file_name()).withColumn("block", F.input_file_block_start())
    tokens = stage(read.mapInArrow(
        tokenise, "file string, block long, part int, place long, n long, tokens binary, doc_ids array<long>, starts array<long>"))
    split = ["file", "block", "part"]
    sums = tokens.groupBy(*split).agg(F.sum("n").alias("n"))
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    count = -(-total // length)

    def cut(batches):
        """Pieces of sequences from a stored unit, together for each shard."""
        for batch in batches:
            for row in batch.to_pylist():
                stream, begin = np.frombuffer(zstandard.decompress(row["tokens"]), np.uint16), row["offset"] + row["place"]
                numbers = np.arange(begin // length, (begin + len(stream) - 1) // length + 1)
                low, high = np.maximum(begin, numbers * length), np.minimum(begin + len(stream), (numbers + 1) * length)
                slots = permute(numbers, count, key)
                starts = begin + np.array(row["starts"], np.int64)
                home = starts // length - numbers[0]  # the sequence in which a document starts
                out = []
                for shard in np.unique(slots // per_shard).tolist():
                    at = np.flatnonzero(slots // per_shard == shard)
                    docs_here = np.flatnonzero(np.isin(home, at))
                    out.append({
                        "shard": shard, "slots": slots[at], "sequences": numbers[at], "places": (low - numbers * length)[at], "sizes": (high - low)[at],
                        "tokens": zstandard.compress(b"".join(stream[low[i] - begin:high[i] - begin].tobytes() for i in at), 3),
                        "doc_ids": [row["doc_ids"][i] for i in docs_here], "doc_slots": slots[home[docs_here]],
                        "starts": (starts - numbers[home] * length)[docs_here]})
                yield pa.RecordBatch.from_pylist(out, PIECES)

    def write(key_, held):
        """Put a shard's pieces in place, write the file, describe its sequences."""
        number = key_[0].as_py()
        first = number * per_shard
        n = min(per_shard, count - first)
        data = np.full((n, length), encoder(words.value).end, np.uint16)
        filled = np.zeros(n, np.int64)
        inside: list[list] = [[] for _ in range(n)]
        sequence = np.zeros(n, np.int64)
        for k in range(held.num_rows):
            row = {name: held[name][k].as_py() for name in held.column_names}
            values = np.frombuffer(zstandard.decompress(row["tokens"]), np.uint16)
            done = 0
            for slot, seq, at, size in zip(row["slots"], row["sequences"], row["places"], row["sizes"]):
                data[slot - first, at:at + size] = values[done:done + size]
                done += size
                filled[slot - first] += size
                sequence[slot - first] = seq
            for slot, start, doc in zip(row["doc_slots"], row["starts"], row["doc_ids"]):
                inside[slot - first].append((start, doc))
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        draft, final = (posixpath.join(root, x) for x in (f".{uuid.uuid4().hex}", shard_name(number)))
        with fs.open_output_stream(draft) as f:
            f.write(data.tobytes())
        fs.move(draft, final)
        inside = [sorted(x, key=lambda y: y[0]) for x in inside]
        return pa.table({
            "slot": pa.array(first + np.arange(n)), "sequence": pa.array(sequence), "shard": pa.array([number] * n, pa.int32()),
            "byte_offset": pa.array(np.arange(n) * length * 2), "n_tokens": pa.array(filled, pa.int32()),
            "sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in data],
            "doc_ids": pa.array([[d for _, d in x] for x in inside], pa.list_(pa.int64())),
            "starts": pa.array([[s for s, _ in x] for x in inside], pa.list_(pa.int32()))})

    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    base = lookup(sums.select(*split, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    pieces = tokens.join(base, split).mapInArrow(cut, PIECE_ROWS)
    return pieces.groupBy("shard").applyInArrow(write, ROWS).withColumn("folder", F.lit(folder))


def read_from(folder: str, slot: int, count: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> np.ndarray:
    """Sequences of up to count slots from a slot on, by seeking to their fixed place."""
    fs, root = _open(folder)
    out = []
    while count > 0:
        name = posixpath.join(root, shard_name(slot // per_shard))
        if not fs.get_file_info(name).is_file:
            break
        n = min(count, per_shard - slot % per_shard)
        with fs.open_input_file(name) as f:
            f.seek(slot % per_shard * length * 2)
            rows = np.frombuffer(f.read(n * length * 2), np.uint16).reshape(-1, length)
        out.append(rows)
        if len(rows) < n:
            break
        slot, count = slot + n, count - n
    return np.concatenate(out) if out else np.zeros((0, length), np.uint16)


def read_frame(spark, folder: str) -> DataFrame:
    """The shards as Spark reads them: path and bytes of each."""
    return spark.read.format("binaryFile").option("pathGlobFilter", re.sub(r"\d+", "*", shard_name(0))).load(folder)
