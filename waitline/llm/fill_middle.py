"""Fill-in-the-middle transformation over SWAR words.

A text's units are its words with the white space before them, and white space at its end. All texts of a
batch lie in one UTF-8 buffer that is viewed as 64-bit words. Arithmetic on whole words marks the bytes
that end a unit; bit counts per word, summed up, rank any byte and find the word that holds the k-th end;
the last step selects the mark within that word. Code points are counted by the same ranks over the bytes
that begin one.

Two cuts and the form follow from a seeded hash of the document's id, so a rerun gives the same rows.
Forms: plain (the text), psm (prefix, suffix, middle) and spm (suffix, prefix, middle), each part behind
its mark. A text that holds a mark stays plain, so the output can always be turned back.

Defined cases: a null text counts as empty and stays plain, with no units and null lengths; a null id is
hashed as no digits; repeated rows are transformed alike; white space alone is one unit; a very long
text is a buffer of its own, and needs a few times its size in memory; no rows give no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waitline.llm.common import texts
from waitline.sources.session import ship_package

SEED, RATE, SPM = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BUFFER = 8 << 20

ONES, HIGH, LOW7 = (np.uint64(x * 0x0101010101010101) for x in (0x01, 0x80, 0x7F))
BYTE, TOP = np.uint64(8), np.uint64(56)


def _each(byte: int) -> np.uint64:
    return np.uint64(byte * 0x0101010101010101)


def white(words: np.ndarray) -> np.ndarray:
    """High bit of every byte that is a space or lies between tab and carriage return."""
    low = words & LOW7
    ascii_ = ~words & HIGH
    above = (low + _each(0x80 - 0x09)) & HIGH     # 9 or more
    beyond = (low + _each(0x80 - 0x0E)) & HIGH    # 14 or more
    space = ~((low ^ _each(0x20)) + LOW7) & HIGH  # 32
    return ((above & ~beyond) | space) & ascii_


def begins(words: np.ndarray) -> np.ndarray:
    """High bit of every byte that begins a code point."""
    return (~words | (words << np.uint64(1))) & HIGH


class Marks:
    """Rank and select over one mark bit per byte."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.until = np.cumsum(np.bitwise_count(words), dtype=np.int64)  # marks up to and within each word

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Number of marks before byte positions."""
        word, bits = at >> 3, (at & 7).astype(np.uint64) * BYTE
        inside = self.words[word] & ((np.uint64(1) << bits) - np.uint64(1))
        return self.until[word] - np.bitwise_count(self.words[word]) + np.bitwise_count(inside)

    def select(self, number: np.ndarray) -> np.ndarray:
        """Byte position of the number-th mark (from 1)."""
        word = np.searchsorted(self.until, number)
        rest = self.words[word].copy()
        left = number - (self.until[word] - np.bitwise_count(rest)) - 1
        for step in range(7):
            rest = np.where(left > step, rest & (rest - np.uint64(1)), rest)
        lowest = rest & (~rest + np.uint64(1))
        return word * 8 + (np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) >> 3)


def unit_ends(words: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Marks of the bytes that end a unit: other than white space with white space behind, and each text's last byte."""
    space = white(words)
    behind = space >> BYTE
    behind[:-1] |= space[1:] << TOP
    ends = ~space & behind & HIGH
    np.bitwise_or.at(ends, last >> 3, np.uint64(0x80) << ((last & 7).astype(np.uint64) * BYTE))
    return ends


def numbers(ids: list, seed: int) -> np.ndarray:
    """Four unsigned 32-bit numbers per id, from the SHA-256 of seed and id."""
    raw = b"".join(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).digest()[:16] for k in ids)
    return np.frombuffer(raw, ">u4").reshape(-1, 4).astype(np.int64)


def transform(ids: list, held: list[bytes], seed: int, rate: int, spm: int) -> tuple:
    """Numbers of units, forms, lengths of prefix and middle, and outputs of a buffer of texts."""
    sizes = np.array([len(t) for t in held], np.int64)
    start = np.concatenate([[0], np.cumsum(sizes)])
    start, stop = start[:-1], start[1:]
    whole = b"".join(held)
    words = np.frombuffer(whole + b" " * (16 - len(whole) % 8), "<u8")
    ends, points = Marks(unit_ends(words, stop[sizes > 0] - 1)), Marks(begins(words))
    first = ends.rank(start)
    n = ends.rank(stop) - first
    h = numbers(ids, seed)
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    at = [start.copy(), start.copy()]
    for place, k in zip(at, cuts.T):
        place[k > 0] = ends.select((first + k)[k > 0]) + 1
    lengths = [points.rank(at[0]) - points.rank(start), points.rank(at[1]) - points.rank(at[0])]
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    forms, outputs = [], []
    for i, text in enumerate(held):
        if not text or h[i, 2] % 100 >= rate or any(m in text for m in marks):
            forms.append("plain")
            outputs.append(text)
            continue
        a, b = at[0][i] - start[i], at[1][i] - start[i]
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        forms.append("spm" if h[i, 3] % 100 < spm else "psm")
        parts = (marks[1], suffix, marks[0], prefix) if forms[-1] == "spm" else (marks[0], prefix, marks[1], suffix)
        outputs.append(b"".join([*parts, marks[2], middle]))
    return n, forms, lengths, outputs


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain) and output of every whole text.

    rate: share of texts transformed, spm: share of these in suffix-first order, both in hundredths.
    """
    ship_package(docs.sparkSession)

    def run(batches):
        for b in batches:
            ids, column = b["doc_id"].to_pylist(), b["text"].cast(pa.binary())
            low = 0
            while low < len(ids):
                held, size = [], 0
                while low + len(held) < len(ids) and (not held or size < BUFFER):
                    held.append(column[low + len(held)].as_py())
                    size += len(held[-1])
                part = ids[low:low + len(held)]
                low += len(held)
                n, forms, lengths, outputs = transform(part, held, seed, rate, spm)
                plain = np.array([f == "plain" for f in forms])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int64()), pa.array(n, pa.int64()), pa.array(forms, pa.string()),
                     *[pa.array(x, pa.int64(), mask=plain) for x in lengths], pa.array(outputs, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return texts(docs).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text a transformed one came from."""
    parts = F.split(output, "<[PSM]>")
    part = lambda i: F.element_at(parts, i)
    return (F.when(form == "psm", F.concat(part(2), part(4), part(3)))
            .when(form == "spm", F.concat(part(3), part(4), part(2))).otherwise(output))
