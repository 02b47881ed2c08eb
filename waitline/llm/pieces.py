"""SentencePiece encoding and decoding: best segmentation under the model's piece scores, by a max-plus scan.

A text's best segmentation is a longest path over its characters. Giant texts are cut into chunks at
fixed places. The state at a cut is how many characters the piece lying across it still needs, so a chunk
is a small matrix of best scores from entry state to exit state, and matrices combine by the associative
max-plus product, level by level over groups of chunks. Carried down again, the products give each chunk the
scores of its entry states; chunks then say which entry each exit leads back to, these maps compose the same
way from the end, and every chunk traces its own pieces.

The model file is read on the driver and sent with the task. Scores of a unigram model are log-probabilities
and used as they are; a BPE model has merge ranks instead, and its pieces get the log-probability that the
Zipf-Mandelbrot law gives their rank. Characters no piece covers become byte pieces.

Defined cases: a null text counts as empty and has no ids; on equal scores the longest last piece wins, as
in the usual lattice search, for whole and for cut texts alike; U+2581 in a text decodes to a space, the one
character that does not come back; repeated rows are encoded one by one; no rows give no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waitline.llm.common import chunks, small_batches, texts
from waitline.sources.session import ship_package
from waitline.sources.tables import stage

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 65_536
MEMO = 350_000
FAN = 16  # matrices multiplied in one step of the scan
UNITS, SHIFT = 1 << 20, 100
SPACE = "▁"
NONE = -np.inf
ENCODED = "doc_id long, n_chars long, n_tokens long, ids array<int>, decoded_sha256 string, round_trip boolean"


class Pieces:
    """The model's pieces; segments of a text between certain boundaries are solved once and remembered."""

    def __init__(self, proto: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        odd = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.bytes = {sp.id_to_piece(i): i for i in range(n) if sp.is_byte(i)}
        self.byte = [self.bytes.get(f"<0x{b:02X}>", sp.unk_id()) for b in range(256)]
        usual = [i for i in range(n) if not odd[i] and not sp.is_byte(i)]
        scores = {i: sp.get_score(i) for i in usual}
        if all(s <= 0 and s == int(s) for s in scores.values()):  # ranks of merges
            order = sorted(usual, key=lambda i: (-scores[i], i))
            scores = {i: -math.log(SHIFT + rank) for rank, i in enumerate(order)}
        # Whole numbers, so that sums do not depend on where a text is cut.
        self.known = {sp.id_to_piece(i): (float(round(UNITS * s)), i) for i, s in scores.items()}
        self.longest = max(map(len, self.known))
        self.unknown = min(s for s, _ in self.known.values()) - 10.0 * UNITS
        self.raw = [b""] * n
        for piece, (_, i) in self.known.items():
            self.raw[i] = piece.replace(SPACE, " ").encode()
        for piece, i in self.bytes.items():
            self.raw[i] = bytes([int(piece[3:5], 16)])
        # Scores by prefix: 0 for the beginning of longer pieces only.
        self.prefix = dict.fromkeys((p[:k] for p in self.known for k in range(1, len(p))), 0.0)
        self.prefix |= {p: score for p, (score, _) in self.known.items()}
        # Parts of a text between certain boundaries: space marks go with what follows; letters apart from
        # other signs, or all up to the next space mark, or no parts; the finest way that splits no piece.
        signs = {c for p in self.known for c in p} - {SPACE}
        one = lambda kind: "[" + "".join(map(re.escape, sorted(c for c in signs if kind(c)))) + "]"
        ways = [f"{SPACE}*{one(str.isalpha)}+|{SPACE}*{one(lambda c: not c.isalpha())}+|{SPACE}+|(?s:.)",
                f"{SPACE}*{one(bool)}+|{SPACE}+|(?s:.)", "(?s).+"]
        self.parts = next(r for r in map(re.compile, ways) if all(len(r.findall(p)) == 1 for p in self.known))
        self.memo: dict[str, tuple[float, bytes]] = {}

    def ids(self, s: str, bounds: list[int]) -> bytes:
        """Ids (32 bit) of the pieces between consecutive bounds."""
        out = array("i")
        for i, j in zip(bounds, bounds[1:]):
            found = self.known.get(s[i:j])
            if found:
                out.append(found[1])
            else:
                out.extend([self.byte[b] for b in s[i:j].encode("utf-8", "surrogatepass")])
        return out.tobytes()

    def forward(self, s: str, start: dict[int, float], stop: int) -> tuple[list, list]:
        """Best score of each boundary and where its last piece began (-1: before s). Pieces start before stop."""
        best, back = [NONE] * (len(s) + 1), [-1] * (len(s) + 1)
        for a, score in start.items():
            best[a] = score
        scores, n, unknown = self.prefix, len(s), self.unknown
        for i in range(stop):
            here = best[i]
            if here > NONE:
                single = False
                for j in range(i + 1, n + 1):
                    score = scores.get(s[i:j])
                    if score is None:
                        break
                    if score:
                        single |= j == i + 1
                        if here + score > best[j]:
                            best[j], back[j] = here + score, i
                if not single and here + unknown > best[i + 1]:
                    best[i + 1], back[i + 1] = here + unknown, i
        return best, back

    @staticmethod
    def trace(back: list, end: int) -> list[int]:
        bounds = [end]
        while back[bounds[-1]] >= 0:
            bounds.append(back[bounds[-1]])
        return bounds[::-1]

    def solve(self, part: str) -> tuple[float, bytes]:
        """Score and ids of a segment between two certain boundaries."""
        found = self.memo.get(part)
        if found is None:
            best, back = self.forward(part, {0: 0.0}, len(part))
            found = best[-1], self.ids(part, self.trace(back, len(part)))
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[part] = found
        return found

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        memo, solve = self.memo, self.solve
        return b"".join([(memo.get(p) or solve(p))[1] for p in self.parts.findall(SPACE + text.replace(" ", SPACE))])

    def split(self, body: str, ahead: str) -> tuple[int, list[str], str]:
        """A chunk's certain boundaries: length of the part before the first, the parts between, the part after the last.

        Without one, all is the first part and the last is empty.
        """
        cuts = [m.start() for m in self.parts.finditer(body)][1:]
        if not cuts:
            return len(body), [], ""
        return cuts[0], [body[a:b] for a, b in zip(cuts, cuts[1:])], body[cuts[-1]:] + ahead

    def exits(self, s: str, n: int, start: dict[int, float]) -> np.ndarray:
        """Scores of the exit states of s[:n], given those of its boundaries."""
        best, _ = self.forward(s, start, n)
        out = np.full(self.longest, NONE)
        out[:len(s) - n + 1] = best[n:n + self.longest]
        return out

    def matrix(self, body: str, ahead: str) -> np.ndarray:
        """Best scores from entry state (rows) to exit state (columns)."""
        first, middle, last = self.split(body, ahead)
        out = np.full((self.longest, self.longest), NONE)
        for a in range(min(self.longest, len(body) + len(ahead) + 1)):  # a piece may also lie over the whole chunk
            if not last:
                out[a] = self.exits(body + ahead, len(body), {a: 0.0})
            elif a <= first:
                best, _ = self.forward(body[:first], {a: 0.0}, first)
                out[a, 0] = best[first]
        if last:
            score = sum(self.solve(p)[0] for p in middle)
            out = out[:, :1] + score + self.exits(last, len(last) - len(ahead), {0: 0.0})[None, :]
        return out

    def ways(self, body: str, ahead: str, entry: list[float]) -> tuple[list, list]:
        start = {a: v for a, v in enumerate(entry[:len(body) + len(ahead) + 1]) if v > NONE}
        return self.forward(body + ahead, start, len(body))

    def entries(self, body: str, ahead: str, entry: list[float]) -> list[int]:
        """For each exit state the entry state its best path came from (-1: not reached)."""
        best, back = self.ways(body, ahead, entry)
        n = len(body)
        return [self.trace(back, n + b)[0] if n + b < len(best) and best[n + b] > NONE else -1 for b in range(self.longest)]

    def piece_ids(self, body: str, ahead: str, entry: list[float], leave: int) -> bytes:
        _, back = self.ways(body, ahead, entry)
        return self.ids(body + ahead, self.trace(back, len(body) + leave))

    def decode(self, ids: np.ndarray) -> bytes:
        raw = self.raw
        return b"".join([raw[i] for i in ids.tolist()])[1:]


_loaded: dict[int, Pieces] = {}


def pieces(proto: bytes) -> Pieces:
    key = zlib.crc32(proto)
    if key not in _loaded:
        _loaded[key] = Pieces(proto)
    return _loaded[key]


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _batch(names: dict, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, names.values())],
                                      names=list(names))


def _lists(parts: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _digest(model: Pieces, text: str, ids: bytes) -> tuple[str, bool]:
    back = model.decode(np.frombuffer(ids, np.int32))
    return hashlib.sha256(back).hexdigest(), back == text.encode("utf-8", "surrogatepass")


OUT = {"doc_id": pa.int64(), "n_chars": pa.int64(), "n_tokens": pa.int64(), "ids": pa.list_(pa.int32()),
       "decoded_sha256": pa.string(), "round_trip": pa.bool_()}


def encode(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_chars, n_tokens, ids, decoded_sha256 (of the text the ids decode to) and round_trip."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    proto = read_model(model)

    def whole(batches):
        m = pieces(proto)
        for held in chunks(batches, 1 << 20):
            ids = [m.encode(text) for _, text in held]
            checks = [_digest(m, text, i) for (_, text), i in zip(held, ids)]
            yield _batch(OUT, [k for k, _ in held], [len(t) for _, t in held], [len(i) // 4 for i in ids], _lists(ids),
                         *zip(*checks))

    rows = texts(docs)
    long = F.length("text") > chunk
    return rows.where(~long).mapInArrow(whole, ENCODED).unionByName(_encode_long(rows.where(long), proto, chunk))


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two matrices of best scores: the best way through both. Associative."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def _level(parts: DataFrame, value: str, combine, schema: str) -> DataFrame:
    """One level of the scan: FAN neighbours (row, k) become one (row, k div FAN), folded in order by `combine`.

    A text's values are spread by group, so a giant text is combined by many tasks.
    """
    grouped = parts.groupBy("row", F.floor(F.col("k") / FAN).cast("int").alias("up")).agg(F.array_sort(F.collect_list(F.struct("k", value))).alias("held"))
    held = grouped.select("row", F.col("up").alias("k"), F.transform("held", lambda x: x[value]).alias("held"))

    def run(batches):
        for b in batches:
            yield _batch({"row": 0, "k": 0, value: pa.list_(pa.float64() if value == "matrix" else pa.int32())}, b["row"], b["k"],
                         [combine(x.as_py()) for x in b["held"]])

    return stage(held.repartition("row", "k").mapInArrow(run, schema))


def _product(matrices: list[list[float]], n: int) -> list[float]:
    out = np.asarray(matrices[0]).reshape(n, n)
    for m in matrices[1:]:
        out = max_plus(out, np.asarray(m).reshape(n, n))
    return out.ravel().tolist()


def _composed(maps: list[list[int]]) -> list[int]:
    """Entry state of the first chunk for each exit state of the last."""
    out = maps[-1]
    for m in reversed(maps[:-1]):
        out = [m[x] if x >= 0 else -1 for x in out]
    return out


def _down(parts: list[DataFrame], value: str, start: list, step, kind: str, backwards: bool) -> DataFrame:
    """From the products of all levels: what each chunk begins with. `state` is carried from group to group.

    parts[0] are the chunks' own values, each further table the products of groups of FAN of the one before.
    step(state, value) goes over one of them; a group's members are gone through from its own state.
    """
    known = None
    for table in reversed(parts):
        rows = table.select("row", "k", F.floor(F.col("k") / FAN).cast("int").alias("up"), value)
        groups = rows.groupBy("row", "up").agg(F.array_sort(F.collect_list(F.struct("k", value))).alias("held"))
        if known is None:
            groups = groups.withColumn("state", F.lit(None).cast(kind))
        else:
            groups = groups.join(known.withColumnRenamed("k", "up"), ["row", "up"])

        def run(batches):
            for b in batches:
                for i in range(b.num_rows):
                    held = b["held"][i].as_py()
                    state = b["state"][i].as_py()
                    state = start if state is None else state
                    out = []
                    for x in reversed(held) if backwards else held:
                        out.append((x["k"], state))
                        state = step(state, x[value])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b["row"][i].as_py()] * len(out), pa.int64()), pa.array([k for k, _ in out], pa.int32()),
                         pa.array([v for _, v in out], pa.list_(pa.float64()) if "double" in kind else pa.list_(pa.int32()))],
                        names=["row", "k", "state"])

        known = stage(groups.repartition("row", "up").mapInArrow(run, f"row long, k int, state {kind}"))
    return known


def _encode_long(rows: DataFrame, proto: bytes, chunk: int) -> DataFrame:
    """The scan over chunks. Matrices are multiplied level by level in groups of FAN, entry scores are carried down
    again, and so are the exit states through the composed maps; then every chunk traces its own pieces. No task
    holds more than FAN matrices of a text or its chunks one by one."""
    longest = pieces(proto).longest
    marked = F.concat(F.lit(SPACE), F.translate("text", " ", SPACE))
    numbers = F.sequence(F.lit(0), F.floor((F.length("marked") - 1) / chunk).cast("int"))
    cut = (rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", marked.alias("marked"))
           .withColumn("k", F.explode(numbers))
           .select("row", "k", F.substring("marked", F.col("k") * chunk + 1, F.lit(chunk)).alias("body"),
                   F.substring("marked", (F.col("k") + 1) * chunk + 1, F.lit(longest - 1)).alias("ahead"),
                   F.when(F.col("k") == 0, F.col("doc_id")).alias("doc_id"), F.when(F.col("k") == 0, F.col("text")).alias("text")))
    cut = stage(cut)
    total, most = cut.agg(F.count(F.lit(1)), F.max("k")).first()
    parts = cut.select("row", "k", "body", "ahead")
    # A given number of tasks: chunks are few bytes but long work, so they would be merged into few.
    tasks = max(1, min(total, 4 * rows.sparkSession.sparkContext.defaultParallelism))
    spread = lambda df: df.repartition(tasks, "row", "k")

    def matrices(batches):
        m = pieces(proto)
        for b in batches:
            values = [m.matrix(x.as_py(), y.as_py()).ravel().tolist() for x, y in zip(b["body"], b["ahead"])]
            yield _batch({"row": 0, "k": 0, "matrix": pa.list_(pa.float64())}, b["row"], b["k"], values)

    def enter(state, flat):
        return (np.asarray(state)[:, None] + np.asarray(flat).reshape(longest, longest)).max(axis=0).tolist()

    def origins(batches):
        m = pieces(proto)
        for b in batches:
            values = [m.entries(x.as_py(), y.as_py(), e.as_py()) for x, y, e in zip(b["body"], b["ahead"], b["entry"])]
            yield _batch({"row": 0, "k": 0, "came": pa.list_(pa.int32())}, b["row"], b["k"], values)

    def traced(batches):
        m = pieces(proto)
        for b in batches:
            values = [m.piece_ids(x.as_py(), y.as_py(), e.as_py(), v.as_py()[0])
                      for x, y, e, v in zip(b["body"], b["ahead"], b["entry"], b["leave"])]
            yield _batch({"row": 0, "k": 0, "ids": pa.list_(pa.int32())}, b["row"], b["k"], _lists(values))

    def decoded(batches):
        m = pieces(proto)
        for b in batches:
            for i in range(b.num_rows):
                text, ids = b["text"][i].as_py(), np.asarray(b["ids"][i].values, np.int32).tobytes()
                sha, same = _digest(m, text, ids)
                yield _batch(OUT, b["doc_id"].slice(i, 1), [len(text)], [len(ids) // 4], _lists([ids]), [sha], [same])

    def levels(first: DataFrame, value: str, combine, schema: str) -> list[DataFrame]:
        out, groups = [first], (most or 0) // FAN + 1
        while groups > 1:
            out.append(_level(out[-1], value, combine, schema))
            groups = (groups - 1) // FAN + 1
        return out

    begin = [0.0] + [NONE] * (longest - 1)
    product = levels(stage(spread(parts).mapInArrow(matrices, "row long, k int, matrix array<double>")), "matrix",
                     lambda held: _product(held, longest), "row long, k int, matrix array<double>")
    entry = _down(product, "matrix", begin, enter, "array<double>", False).withColumnRenamed("state", "entry")
    came = stage(spread(parts.join(entry, ["row", "k"])).mapInArrow(origins, "row long, k int, came array<int>"))
    composed = levels(came, "came", _composed, "row long, k int, came array<int>")
    leave = _down(composed, "came", [0], lambda state, came_: [came_[state[0]]], "array<int>", True).withColumnRenamed("state", "leave")
    ids = spread(parts.join(entry, ["row", "k"]).join(leave, ["row", "k"])).mapInArrow(traced, "row long, k int, ids array<int>")
    joined = ids.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    heads = cut.where("k = 0").select("row", "doc_id", "text")
    return joined.join(heads, "row").select("doc_id", "text", "ids").mapInArrow(decoded, ENCODED)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows of (doc_id, ids)."""
    ship_package(encoded.sparkSession)
    proto = read_model(model)

    def run(batches):
        m = pieces(proto)
        for b in batches:
            back = [m.decode(np.asarray(x.values, np.int32)).decode("utf-8", "surrogatepass") for x in b["ids"]]
            yield _batch({"doc_id": 0, "text": pa.string()}, b["doc_id"], back)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
