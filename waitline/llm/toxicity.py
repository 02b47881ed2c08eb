"""Toxicity: a subsequence string-kernel support vector machine on Nyström landmarks.

Two words are alike as far as they share subsequences of three characters within a span of six, each
weighted by decay ** span, so an insult stays near itself with gaps or inserted characters. The kernel to
a fixed set of landmark words, whitened by their own kernel matrix, gives features for a linear support
vector machine (squared hinge). Labels belong to texts, so training is over bags: a labelled text is
as toxic as its most toxic word, and each round picks that word anew. Kernel and weights together are a
table over character triples, which scores a word in one look-up per subsequence.

Training reads a bounded sample: at most SAMPLE labelled texts of either class, of TRAIN_CHARS characters
at most, in order of a hash of their id. Scoring reads every word of every text.

Defined cases: a null or empty text, or one without letters and digits, scores 0; words longer than a
window are scored in overlapping windows; letters outside ASCII have hashed symbols of their own; letters written apart ("a b c") also count as one word; a label
without a text, or a null label, is not used; of near copies with the same label one is learnt from;
without labels of both classes, or if no word tells toxic texts from others, there is no model, every score
is 0, nothing is rejected, and a warning says so; repeated rows, and rows that share an id or have none, are
scored and rejected each by its own text; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waitline.llm.common import chunks, small_batches, texts
from waitline.sources.session import ship_package
from waitline.sources.tables import stage

SPAN, DECAY = 6, 0.6
SYMBOLS, OPEN, CLOSE = 128, 126, 127
OTHERS = 37  # first of the symbols that letters outside ASCII are hashed to
WINDOW = 30
LANDMARKS, NEGATIVES, ROUNDS, PENALTY = 160, 12_000, 6, 4.0
TELLING = 5  # a suspect word is so many times likelier in toxic texts than in others
SAMPLE, TRAIN_CHARS = 2000, 200_000
THRESHOLD = 0.3
MEMO = 400_000
HELD = 1 << 19  # characters whose words are held at a time
#: Digits and signs read as the letters they stand for.
ALIKE = str.maketrans("013457@$", "oieastas")

CODE = np.zeros(128, np.int64)
CODE[ord("a"):ord("z") + 1] = np.arange(1, 27)
CODE[ord("0"):ord("9") + 1] = 27 + np.arange(10)


class Model(NamedTuple):
    keys: np.ndarray  # character triples
    values: np.ndarray
    bias: float
    slope: float
    shift: float

    def table(self) -> np.ndarray:
        """Value of every character triple."""
        out = np.zeros(SYMBOLS ** 3)
        out[self.keys] = self.values
        return out


def unit(word: str) -> str:
    """Letters and digits of a lower-case word, look-alike signs read as letters."""
    return "".join(filter(str.isalnum, word.translate(ALIKE)))


def bag(text: str) -> set[str]:
    """Distinct words, and runs of letters written apart joined into one."""
    words = text.lower().split()
    out = set(words)
    single = [i for i, w in enumerate(words) if len(w) == 1]
    run: list[int] = []
    for i in [*single, -2]:
        if run and i != run[-1] + 1:
            if len(run) >= 3:
                out.add("".join(words[j] for j in run))
            run = []
        run.append(i)
    return out


def windows(word: str) -> list[str]:
    u = unit(word)
    if len(u) <= WINDOW:
        return [u] if u else []
    return [u[i:i + WINDOW] for i in range(0, len(u) - WINDOW // 2, WINDOW // 2)]


def codes(units: list[str]) -> np.ndarray:
    """Characters as symbols with marks at both ends, padded by 0."""
    width = max(map(len, units))
    raw = np.frombuffer("".join(u.ljust(width, "\0") for u in units).encode("utf-32-le", "surrogatepass"), np.uint32)
    raw = raw.reshape(len(units), width).astype(np.int64)
    inner = np.where(raw < 128, CODE[np.minimum(raw, 127)], OTHERS + raw % (OPEN - OTHERS))
    out = np.zeros((len(units), width + 2), np.int64)
    out[:, 0], out[:, 1:-1] = OPEN, inner
    out[np.arange(len(units)), 1 + (raw > 0).sum(axis=1)] = CLOSE
    return out


PATTERNS = [(i, j, DECAY ** (j + 1)) for i in range(1, SPAN - 1) for j in range(i + 1, SPAN)]


def triples(matrix: np.ndarray):
    """(keys, weight) of the subsequences of every pattern; a key is 0 where the word is over."""
    width = matrix.shape[1]
    for i, j, weight in PATTERNS:
        if j < width:
            a, b, c = matrix[:, :width - j], matrix[:, i:width - j + i], matrix[:, j:]
            yield np.where(c > 0, (a * SYMBOLS + b) * SYMBOLS + c, 0), weight


def norms(matrix: np.ndarray) -> np.ndarray:
    total = sum((weight ** 2 * (keys > 0).sum(axis=1) for keys, weight in triples(matrix)), np.zeros(len(matrix)))
    return np.sqrt(np.maximum(total, 1e-12))


def by_width(units: list[str]):
    """Index groups of units of similar length, so that little is padded."""
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    for low, high in ((0, 8), (8, 14), (14, 22), (22, WINDOW)):
        at = np.flatnonzero((lengths > low) & (lengths <= high))
        for k in range(0, len(at), 5000):
            yield at[k:k + 5000]


def project(units: list[str], marks: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Normalised kernel sums of units against landmarks (one column each), given as row of each triple and rows."""
    row, tables = marks
    out = np.zeros((len(units), tables.shape[1]))
    for at in by_width(units):
        m = codes([units[i] for i in at])
        part = np.zeros((len(at), tables.shape[1]))
        for keys, weight in triples(m):
            for column in range(keys.shape[1]):
                part += weight * tables[row[keys[:, column]]]
        out[at] = part / norms(m)[:, None]
    return out


def evaluate(units: list[str], table: np.ndarray) -> np.ndarray:
    out = np.zeros(len(units))
    for at in by_width(units):
        m = codes([units[i] for i in at])
        out[at] = sum(weight * table[keys].sum(axis=1) for keys, weight in triples(m)) / norms(m)
    return out


def landmark_tables(landmarks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row of each character triple (0: in no landmark) and the landmarks' normalised triple weights by row."""
    coded = [codes([u]) for u in landmarks]
    found = np.unique(np.concatenate([keys[0] for m in coded for keys, _ in triples(m)]))
    found = found[found > 0]
    row = np.zeros(SYMBOLS ** 3, np.int32)
    row[found] = np.arange(1, len(found) + 1)
    out = np.zeros((len(found) + 1, len(landmarks)), np.float32)
    for k, m in enumerate(coded):
        for keys, weight in triples(m):
            np.add.at(out[:, k], row[keys[0]], weight)
        out[0, k] = 0.0
        out[:, k] /= norms(m)[0]
    return row, out


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Primal linear SVM with squared hinge loss by Newton steps over the current support vectors; last entry: bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    keep = np.eye(x.shape[1])
    keep[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        inside = y * (x @ w) < 1
        xs, c = x[inside], penalty * weight[inside]
        new = np.linalg.solve(keep + (xs * c[:, None]).T @ xs, (xs * c[:, None]).T @ y[inside])
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the weighted logistic fit of y on x, softly drawn to a moderate slope."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        g = np.array([(weight * (p - y) * x).sum() + 0.1 * (a - 3.0), (weight * (p - y)).sum()])
        v = weight * p * (1 - p) + 1e-9
        h = np.array([[(v * x * x).sum() + 0.1, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


def evidence(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """Log-likelihood ratio of words' own shares of toxic texts against the overall one."""
    n = np.maximum(toxic + clean, 1)
    log = lambda x: np.log(np.maximum(x, 1e-300))
    return toxic * log(toxic / n / share) + clean * log(clean / n / (1 - share))


def distinct(bags: list[np.ndarray], hashes: np.ndarray, labels: np.ndarray) -> list[int]:
    """Indices of bags that are neither empty nor near copies of earlier ones of the same label.

    A near copy shares one of eight keys of six minima: found nine times in ten at a similarity of 0.8,
    and one time in nine at a half. Texts of other labels are never compared: a sentence with and without
    the insult are two examples.
    """
    multipliers = np.random.Generator(np.random.PCG64(3)).integers(0, 1 << 63, 48, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    taken: set = set()
    out = []
    for i, (b, label) in enumerate(zip(bags, labels.tolist())):
        if len(b):
            low = [int((hashes[b] * m).min()) for m in multipliers]
            keys = {(label, k, *low[k:k + 6]) for k in range(0, 48, 6)}
            if not keys & taken:
                out.append(i)
            taken |= keys
    return out


def train(words: list[str], bags: list[np.ndarray], toxic: np.ndarray, prior: float) -> Model | None:
    """Model from the sorted distinct units, bags of their numbers, and the bags' labels.

    prior: share of toxic texts among all labelled ones.
    """
    hashes = np.fromiter(map(hash_of, words), np.uint64, len(words))
    fresh = distinct(bags, hashes, toxic)
    bags, toxic = [bags[i] for i in fresh], toxic[fresh].astype(bool)
    n_pos, n_neg = int(toxic.sum()), int((~toxic).sum())
    if not n_pos or not n_neg:
        return None
    pos, neg = (np.bincount(np.concatenate([b for b, t in zip(bags, toxic) if t == side]), minlength=len(words)) for side in (True, False))
    odds = pos * (np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1)))
    # A word that clean texts hold as well cannot be what makes a text toxic.
    suspect = odds > pos * np.log(TELLING)
    # Words that chance cannot put into so many toxic texts and so few others count all; the other texts
    # have one word each that makes them toxic.
    proven = suspect & (evidence(pos, neg, n_pos / (n_pos + n_neg)) > np.log(20 * max(1, (pos > 0).sum())))
    guilty = [b[suspect[b]] for b, t in zip(bags, toxic) if t and suspect[b].any() and not proven[b].any()]
    if not guilty and not proven.any():
        return None
    text_of = lambda at: [words[i] for i in at]
    weight = np.where(proven, pos, 0) + np.bincount([b[odds[b].argmax()] for b in guilty], minlength=len(words))
    clean = np.flatnonzero(neg)
    clean = clean[np.argsort(hashes[clean], kind="stable")]
    usual = clean[np.argsort(-neg[clean], kind="stable")][:NEGATIVES // 3]
    hard = clean[:0]
    first = lambda *parts: np.array([*dict.fromkeys(np.concatenate(parts).tolist())], np.int64)
    for step in range(ROUNDS):
        chosen = np.flatnonzero(weight)
        marks = chosen[np.argsort(-weight[chosen], kind="stable")][:LANDMARKS * 3 // 4]
        others = first(hard[:LANDMARKS // 8], usual)
        marks = first(marks, others[weight[others] == 0][:LANDMARKS - len(marks)])
        tables = landmark_tables(text_of(marks))
        spread, vectors = np.linalg.eigh(project(text_of(marks), tables))
        good = spread > 1e-6 * spread[-1]
        white = vectors[:, good] / np.sqrt(spread[good])
        against = first(usual, clean[:NEGATIVES // 3], hard)
        against = against[weight[against] == 0]
        y = np.repeat([1.0, -1.0], [len(chosen), len(against)])
        each = np.concatenate([weight[chosen] / weight[chosen].sum(), np.full(len(against), 1.0 / max(1, len(against)))])
        w = squared_hinge(project(text_of([*chosen, *against]), tables) @ white, y, each * len(y))
        row, rows = tables
        values, bias = rows @ (white @ w[:-1]), w[-1]
        table = values[row]
        hard = clean[np.argsort(-evaluate(text_of(clean), table), kind="stable")[:NEGATIVES // 3]]
        if step % 2 and guilty:  # every other round: words are chosen anew once the nearest clean words have been learnt
            held = np.unique(np.concatenate(guilty))
            score = np.zeros(len(words))
            score[held] = evaluate(text_of(held), table)
            weight = np.where(proven, pos, 0) + np.bincount([b[score[b].argmax()] for b in guilty], minlength=len(words))
    score = evaluate(words, table) + bias
    x = np.array([score[b].max() for b in bags])
    share = np.where(toxic, prior / n_pos, (1 - prior) / n_neg) * len(bags)
    slope, shift = logistic(x, toxic.astype(float), share)
    keys = np.flatnonzero(row)
    return Model(keys, values[row[keys]], float(bias), float(slope), float(shift))


def hash_of(u: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(u.encode("utf-8", "surrogatepass"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = TRAIN_CHARS) -> Model | None:
    """Train on a bounded sample of labelled texts. labels: doc_id, toxic."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    usable = texts(docs).where(F.length("text").between(1, chars))
    # Labels of other texts than these neither use up the sample nor count.
    present = stage(known.join(usable.select("doc_id"), "doc_id", "left_semi"))
    counts = {r["toxic"]: r["count"] for r in present.groupBy("toxic").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = present.where("toxic = 1").orderBy(*order).limit(sample).unionByName(
        present.where("toxic = 0").orderBy(*order).limit(sample))

    def bags_of(batches):
        for b in batches:
            out = [sorted({w for x in bag(t.as_py()) for w in windows(x)}) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["toxic"], pa.array(out, pa.list_(pa.string()))], names=["toxic", "units"])

    picked = F.broadcast(chosen)  # 2 * sample rows at most
    table = usable.join(picked, "doc_id").select("text", "toxic").mapInArrow(bags_of, "toxic int, units array<string>").toArrow()
    toxic, units = table["toxic"].to_numpy(), table["units"].combine_chunks()
    coded = units.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    place = np.argsort(np.array(names, object), kind="stable") if names else np.zeros(0, np.int64)
    number = np.empty(len(names), np.int32)
    number[place] = np.arange(len(names), dtype=np.int32)
    cuts = np.cumsum(units.value_lengths().to_numpy(zero_copy_only=False))
    bags = np.split(number[coded.indices.to_numpy(zero_copy_only=False)], cuts[:-1]) if len(cuts) else []
    # The same whatever task came first.
    order = sorted(range(len(bags)), key=lambda i: (bags[i].tobytes(), toxic[i]))
    model = train([names[i] for i in place], [bags[i] for i in order], toxic[order], counts[1] / (counts[0] + counts[1]))
    if model is None:
        warnings.warn("no word tells toxic texts from others: every score is 0", stacklevel=2)
    return model


class Scorer:
    def __init__(self, model: Model):
        self.model, self.table, self.memo = model, model.table(), {}

    def learn(self, words: set[str]) -> None:
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = [w for w in words if w not in self.memo]
        parts = [windows(w) for w in new]
        flat = [u for p in parts for u in p]
        values = iter((evaluate(flat, self.table) + self.model.bias).tolist() if flat else ())
        for w, p in zip(new, parts):
            self.memo[w] = max([next(values) for _ in p], default=-np.inf)

    def score(self, held: list[str]) -> list[float]:
        found = [bag(t) for t in held]
        self.learn(set().union(*found))
        memo, a, b = self.memo, self.model.slope, self.model.shift
        top = np.array([max(map(memo.__getitem__, s), default=-np.inf) for s in found])
        return np.where(top == -np.inf, 0.0, 1 / (1 + np.exp(-np.clip(a * top + b, -40, 40)))).tolist()


def score_texts(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every document. No shuffle; the model (0.5 MB) goes with the task."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    if model is None:
        return texts(docs).select("doc_id", F.lit(0.0).alias("score")).select("doc_id", "score", predicted)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches):
        scorer = Scorer(Model(*shared.value))
        for held in chunks(batches, HELD):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in held], pa.int64()), pa.array(scorer.score([t for _, t in held]), pa.float64())],
                names=["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double").select("doc_id", "score", predicted)


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, training: Column | None = None) -> DataFrame:
    """docs without those predicted toxic, all columns kept; each row goes by its own text, whatever its id.

    training: which rows may be learnt from (default: all).
    """
    model = fit(docs if training is None else docs.where(training), labels)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    @F.pandas_udf("double")
    def score(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(Model(*shared.value))
        for held in series:
            part, out, size = [], [], 0
            for text in held:
                part.append(text)
                size += len(text)
                if size > HELD:
                    out += scorer.score(part)
                    part, size = [], 0
            yield pd.Series(out + (scorer.score(part) if part else []), dtype=float)

    return docs.where(score(F.coalesce("text", F.lit(""))) < threshold)
