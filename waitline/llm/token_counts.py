"""Token counts by overlap resynchronisation.

Texts up to `chunk` characters are encoded whole. A giant text is cut into chunks that overlap by a few
hundred characters; every chunk is encoded on its own, with offsets. Two neighbours are spliced at the
first place of their overlap that is a token boundary in both encodings and is proven stable: a place that
the tokenizer never joins over, whatever stands around it, so that the tokens before it depend on the text
before it only, and those after it on the text after it. If an overlap holds no such place it is widened,
fourfold at a time and up to a whole chunk on either side; a cut that stays without one is given up and
its chunks become one span. The counts of the spans between splices add up to that of the whole text.

What is proven stable follows from the tokenizer's own set-up:
* byte-level BPE with its usual splitting pattern joins letters, digits, other signs and white space only
  with their own kind, but for one leading space and the apostrophe of a contraction. So it never joins
  over a change of kind that follows anything but white space. Added strings ("<|endoftext|>") must not
  lie across the place either.
* a SentencePiece model none of whose pieces holds a space mark after another sign, and that puts one
  space before each text, never joins over a single space between two ASCII letters or digits. The part
  after the place is encoded without its space, which the model puts back.
* of any other set-up nothing is proven: its texts are encoded whole.

Defined cases: a null text counts as empty and has no tokens; added strings inside a text count as the
library's default has it; a text that holds no stable place over more than a chunk (one run of letters, say)
is encoded as one span, as it is for the tokenizer, and needs memory for that span; repeated rows and ids
are counted one by one; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waitline.llm.common import chunks, texts
from waitline.sources.session import ship_package
from waitline.sources.tables import stage

TOKENIZER = "byte_bpe_50k.json"
CHUNK, OVERLAP, LIMIT = 65_536, 512, 1024
BATCH = 1 << 20

# Signs whose kind no version of Unicode changes.
WHITE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS = r"A-Za-zÀ-ÖØ-öø-ÿа-яА-Яぁ-ゖァ-ヺ一-龥"
DIGITS = r"0-9"
SIGNS = r"!-&(-/:-@\[-`{-~、。！，：；？"
KINDS = regex.compile(
    rf"(?<=[^{WHITE}])(?=[\t\n\r ])|(?<=[{LETTERS}])(?=[{DIGITS}{SIGNS}'])|(?<=[{DIGITS}])(?=[{LETTERS}{SIGNS}'])"
    rf"|(?<=[{SIGNS}'])(?=[{DIGITS}])|(?<=[{SIGNS}])(?=[{LETTERS}])")
WORDS = regex.compile(r"(?<=[A-Za-z0-9])(?= [A-Za-z0-9])")


class JsonTokenizer:
    """A tokenizers file."""

    skip = 0

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_str(data.decode())
        self.library.no_truncation()
        self.library.no_padding()
        setup = json.loads(data)
        split, model = setup.get("pre_tokenizer") or {}, setup["model"]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.proven = bool(plain and not setup.get("normalizer") and model["type"] == "BPE" and not model.get("dropout"))
        added = setup.get("added_tokens") or []
        self.added = [a["content"] for a in added]
        self.proven &= not any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in added)
        self.margin = max(map(len, self.added), default=0)

    def counts(self, held: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch_fast(held, add_special_tokens=False)]

    def starts(self, text: str) -> np.ndarray:
        """Where each token begins, in characters."""
        return np.array([a for a, _ in self.library.encode(text, add_special_tokens=False).offsets], np.int64)

    def stable(self, text: str) -> np.ndarray:
        if not self.proven:
            return np.zeros(0, np.int64)
        at = np.array([m.start() for m in KINDS.finditer(text)], np.int64)
        for string in self.added:
            for m in regex.finditer(regex.escape(string), text, overlapped=True):
                at = at[(at <= m.start()) | (at >= m.end())]
        return at


class PieceTokenizer:
    """A SentencePiece model."""

    skip, margin = 1, 0

    def __init__(self, data: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        names = map(self.library.id_to_piece, range(self.library.get_piece_size()))
        self.proven = not any("▁" in n.lstrip("▁") for n in names) and self.library.encode("a", out_type=str)[0].startswith("▁")

    def counts(self, held: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode(held, num_threads=1)]

    def starts(self, text: str) -> np.ndarray:
        begins = np.array([p.begin for p in self.library.encode(text, return_type="proto").pieces], np.int64)  # in bytes
        raw = np.frombuffer(text.encode(), np.uint8)
        return np.concatenate([[0], np.cumsum(raw & 0xC0 != 0x80)])[begins]

    def stable(self, text: str) -> np.ndarray:
        return np.array([m.start() for m in WORDS.finditer(text)] if self.proven else [], np.int64)


_loaded: dict[int, JsonTokenizer | PieceTokenizer] = {}


def tokenizer(data: bytes) -> JsonTokenizer | PieceTokenizer:
    key = zlib.crc32(data)
    if key not in _loaded:
        _loaded[key] = JsonTokenizer(data) if data.lstrip()[:1] == b"{" else PieceTokenizer(data)
    return _loaded[key]


def boundaries(t, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable places of a text that are token boundaries, the number of tokens before each, and all token starts.

    Places too near to either end for an added string across them to be seen are left out.
    """
    at, starts = t.stable(text), t.starts(text)
    at = at[(at >= t.margin) & (at <= len(text) - t.margin)]
    at = at[np.isin(at, starts)]
    return at, np.searchsorted(starts, at), starts


def splice(t, left: str, right: str, chunk: int, overlap: int) -> int:
    """Place after a cut where the encodings of the texts before and after it agree for good, or -1.

    left and right meet at the cut. Both sides are read `overlap` characters wide, fourfold wider each time.
    """
    while overlap < 4 * chunk:
        overlap = min(overlap, chunk)
        tail = left[-overlap:]
        both, alone = tail + right[:overlap], right[:overlap]
        first, second = boundaries(t, both)[0] - len(tail), boundaries(t, alone)[0]
        common = np.intersect1d(first, second)
        if len(common):
            return int(common[0])
        overlap *= 4
    return -1


COUNTED = "doc_id long, n_bytes long, n_tokens long"


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _longs(values) -> pa.Array:
    return pa.array(values, pa.int64())


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK,
                 overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text. path: a tokenizers (.json) or SentencePiece file."""
    ship_package(docs.sparkSession)
    with open(path or public_tokenizers.path(TOKENIZER), "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def whole(batches):
        t = tokenizer(shared.value)
        for held in chunks(batches, BATCH):
            words = [text for _, text in held]
            yield _batch(doc_id=_longs([k for k, _ in held]), n_bytes=_longs([len(w.encode()) for w in words]),
                         n_tokens=_longs(t.counts(words)))

    rows = texts(docs)
    long = F.length("text") > chunk
    short = rows.where(~long).mapInArrow(whole, COUNTED)
    return short.unionByName(_count_long(rows.where(long), shared, chunk, overlap)).withColumn("over_limit", F.col("n_tokens") > limit)


def _count_long(rows: DataFrame, shared, chunk: int, overlap: int) -> DataFrame:
    """Chunks are rows of their own; what neighbours exchange are the boundaries of one overlap."""
    def cut(batches):
        for b in batches:
            for row, key, text in zip(b["row"].to_pylist(), b["doc_id"].to_pylist(), b["text"]):
                text = text.as_py()
                size = len(text.encode())
                for k in range(-(-len(text) // chunk)):
                    yield _batch(row=_longs([row]), k=pa.array([k], pa.int32()), doc_id=_longs([key]), n_bytes=_longs([size]),
                                 body=pa.array([text[k * chunk:(k + 1) * chunk]]),
                                 ahead=pa.array([text[(k + 1) * chunk:(k + 1) * chunk + overlap]]))

    def encode(batches):
        """The stable boundaries in the overlaps at both ends of a chunk, with the tokens before them, and its last count."""
        t = tokenizer(shared.value)
        for b in batches:
            for i in range(b.num_rows):
                body, ahead = b["body"][i].as_py(), b["ahead"][i].as_py()
                at, before, starts = boundaries(t, body + ahead)
                head, tail = at <= overlap - t.margin, at >= len(body) + t.margin
                lists = [pa.array([x], pa.list_(pa.int64())) for x in (at[head], before[head], at[tail] - len(body), before[tail])]
                yield _batch(row=b["row"].slice(i, 1), k=b["k"].slice(i, 1), n=_longs([len(starts)]),
                             head=lists[0], head_n=lists[1], tail=lists[2], tail_n=lists[3])

    def widen(batches):
        t = tokenizer(shared.value)
        for b in batches:
            found = [splice(t, x.as_py(), y.as_py(), chunk, 4 * overlap) for x, y in zip(b["left"], b["right"])]
            yield _batch(row=b["row"], k=b["k"], at=_longs(found))

    def recount(batches):
        t = tokenizer(shared.value)
        for b in batches:
            for i in range(b.num_rows):
                part = "".join(b["parts"][i].as_py())
                yield _batch(row=b["row"].slice(i, 1), n=_longs(t.counts([part[t.skip if b["span"][i].as_py() else 0:]])))

    marked = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    cuts = stage(marked.mapInArrow(cut, "row long, k int, doc_id long, n_bytes long, body string, ahead string"))
    views = cuts.select("row", "k", "body", "ahead").repartition("row", "k").mapInArrow(
        encode, "row long, k int, n long, head array<long>, head_n array<long>, tail array<long>, tail_n array<long>")
    # A text is 2 GB at most, so a window holds the boundaries of some ten thousand chunks.
    along = Window.partitionBy("row").orderBy("k")
    at = F.array_min(F.array_intersect("tail", F.lead("head").over(along)))
    number = lambda n, places, place: F.element_at(F.col(n), F.array_position(F.col(places), place).cast("int"))
    met = views.withColumn("at", at).withColumn("final", F.lead("k").over(along).isNull()).withColumn("entry", F.lag("at").over(along))
    met = stage(met.select("row", "k", "at", "final", ((F.col("k") == 0) | F.col("entry").isNotNull()).alias("entered"),
                           F.coalesce(number("head_n", "head", F.col("entry")), F.lit(0)).alias("before"),
                           F.when(F.col("final"), F.col("n")).otherwise(number("tail_n", "tail", F.col("at"))).alias("until")))
    body = cuts.select("row", "k", "body")
    ahead = body.select("row", (F.col("k") - 1).alias("k"), F.col("body").alias("right"))
    wider = (met.where("at is null and not final").select("row", "k").join(body.withColumnRenamed("body", "left"), ["row", "k"])
             .join(ahead, ["row", "k"]).mapInArrow(widen, "row long, k int, at long").where("at >= 0").withColumnRenamed("at", "wide"))
    # A span reaches from splice to splice. One within a chunk whose ends met at once has its count.
    entry = F.lag(F.coalesce("at", "wide")).over(along)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    spans = stage(met.join(wider, ["row", "k"], "left").select(
        "row", "k", (F.col("until") - F.col("before")).alias("n"), (F.col("entered") & (F.col("at").isNotNull() | F.col("final"))).alias("sure"),
        entry.alias("entry"), F.coalesce(F.count(F.coalesce("at", "wide")).over(earlier), F.lit(0)).alias("span")))
    open_ = spans.where("not sure").select("row", "span").distinct()
    start = F.coalesce(F.col("entry"), F.lit(0))
    share = lambda span, low, n: F.struct(span.alias("span"), low.alias("low"), n.alias("n"))
    parts = spans.select("row", "k", F.explode(F.array(
        share(F.col("span"), start, F.lit(chunk).cast("long")), share(F.col("span") - 1, F.lit(0).cast("long"), start))).alias("x"))
    parts = parts.select("row", "k", "x.*").where("n > 0").join(open_, ["row", "span"], "left_semi").join(body, ["row", "k"])
    held = F.transform(F.array_sort(F.collect_list(F.struct("k", F.substring("body", F.col("low") + 1, F.col("n")).alias("part")))), lambda x: x["part"])
    again = parts.groupBy("row", "span").agg(held.alias("parts")).select("row", "span", "parts").mapInArrow(recount, "row long, n long")
    totals = spans.where("sure").select("row", "n").unionByName(again).groupBy("row").agg(F.sum("n").alias("n_tokens"))
    return cuts.where("k = 0").select("row", "doc_id", "n_bytes").join(totals, "row").select("doc_id", "n_bytes", "n_tokens")
