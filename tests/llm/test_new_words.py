"""Token counts, fill-in-the-middle and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from test_operators import odd_rows, table

from waitline.llm import fill_middle, queries, spelling, token_counts

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, odd_rows()).repartition(3)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def rows_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def by_text(rows):
    return sorted(rows, key=str)


# Token counts --------------------------------------------------------------------------------

def library(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(sp.encode(text))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


SIGNS = [" ", "  ", "\n", "a", "b", "the", "don't", "'s", "'", "1", "23", "<|endoftext|>", "<|endof", "日本", "、", "é", "😀", " ", "\t",
         "ß", "!?", "x" * 50, "　", "\r\n", "И", "мир", "é"]


def mixed_texts(seed, n, most):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"])
@pytest.mark.parametrize("chunk,overlap", [(60, 30), (200, 32), (65_536, 512)])
def test_counts_equal_the_library(spark, name, chunk, overlap):
    rows = [*enumerate(mixed_texts(5, 100, 120))]
    rows += [(1000, None), (1001, ""), (1002, "a" * 700), (None, "a b " * 90), (1003, "a" * 300 + " b" * 100 + "c" * 300),
             (1003, "a" * 300 + " b" * 100 + "c" * 300), (1004, "<|endoftext|>" * 50), (1005, " " * 400), (1006, "日本" * 200 + "、" + "語" * 100)]
    docs = table(spark, [(k, t, "s") for k, t in rows]).repartition(3)
    got = token_counts.count_tokens(docs, public_tokenizers.path(name), limit=40, chunk=chunk, overlap=overlap)
    count = library(name)
    want = [(k, len((t or "").encode()), count(t or ""), count(t or "") > 40) for k, t in rows]
    assert by_text(map(tuple, got.collect())) == by_text(want)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_stable_places_part_any_text(name):
    """Tokens of both sides of a stable place are those of the whole."""
    with open(public_tokenizers.path(name), "rb") as f:
        t = token_counts.tokenizer(f.read())
    assert t.proven
    places = 0
    for text in mixed_texts(11, 300, 40):
        whole = t.counts([text])[0]
        for at in t.stable(text).tolist():
            places += 1
            left, right = t.counts([text[:at], text[at + t.skip:]])
            assert left + right == whole and at in t.starts(text), (text, at)
    assert places > 10


def test_overlaps_are_widened_until_they_align():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        t = token_counts.tokenizer(f.read())
    assert token_counts.splice(t, "x" * 1000, "y" * 500 + " z " + "y" * 497, 1000, 32) == 500
    assert token_counts.splice(t, "x" * 1000, "y" * 1000, 1000, 32) == -1


def test_token_query_over_whole_texts(spark, small):
    count = library("byte_bpe_50k.json")
    got = queries.QUERIES["op11_token_counts"](spark, SMALL)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(k, len(t.encode()), count(t), count(t) > 1024) for k, t in rows_of(small)]
    assert by_text(map(tuple, got.collect())) == by_text(want)


# Fill in the middle --------------------------------------------------------------------------

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def filled(key, text):
    units = UNITS.findall(text)
    d = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(d[8 * j:8 * j + 8], 16) for j in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return key, len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return key, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def middle_rows():
    rng = random.Random(3)
    signs = [" ", "  ", "\n", "a", "the", "\t", "日本", "é", "😀", " ", "\x0e", "\x08", "!", "\x1f", "<", "<P", "S>", ">"]
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(30)))) for i in range(300)]
    return rows + [(i, f"some text {m} with a mark") for i, m in zip(range(400, 420), ["<P>", "<S>", "<M>", "< M>"] * 5)] + [
        (500, None), (None, "no id at all"), (501, ""), (502, " "), (503, "w " * 50_000), (504, "x" * 100_000), (504, "x" * 100_000)]


def test_middles_against_a_plain_rewrite(spark, docs):
    rows = middle_rows()
    for df, given in ((table(spark, [(k, t, "s") for k, t in rows]).repartition(4), rows), (docs, rows_of(docs))):
        out = fill_middle.fill_middle(df).cache()
        want = [filled(k, t or "") for k, t in given]
        assert by_text(map(tuple, out.collect())) == by_text(want)
        back = out.select("doc_id", fill_middle.restored(out["output"], out["form"]))
        assert by_text(map(tuple, back.collect())) == by_text([(k, t or "") for k, t in given])
    assert {f[2] for f in want} == {"plain", "spm", "psm"}


def test_marks_rank_and_select():
    rng = np.random.default_rng(1)
    raw = rng.choice(np.frombuffer(b"ab \t\n\r\x08\x0e\x1f\x21\xa0\xff", np.uint8), 4096)
    words = raw.view("<u8")
    bits = np.isin(raw, [9, 10, 11, 12, 13, 32])
    assert (fill_middle.white(words).view(np.uint8) == bits * 0x80).all()
    assert (fill_middle.begins(words).view(np.uint8) == (raw & 0xC0 != 0x80) * 0x80).all()
    marks = fill_middle.Marks(fill_middle.white(words))
    assert (marks.rank(np.arange(4096)) == np.cumsum(bits) - bits).all()
    assert (marks.select(np.arange(1, bits.sum() + 1)) == np.flatnonzero(bits)).all()


# Spelling variants ---------------------------------------------------------------------------

def variants(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = {w: set() for w in n}
    holes = {}
    for w in n:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1:]), set()).add(w)
            shorter = w[:i] + w[i + 1:]
            if shorter in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    top = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: t if t is not None and n[t] >= 10 * n[w] else None for w, t in top.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return [(w, form[w], root(w), n[w], len(near[w]), None if form[w] is None else n[form[w]]) for w in n]


def spelled_rows():
    rng = random.Random(4)
    base = ["internationalisation"[:k] for k in range(6, 20)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "éàüöñçß", "Ünïcodeÿ×÷"]
    rows = []
    for i in range(500):
        words = []
        for _ in range(rng.randrange(60)):
            w = rng.choice(base)
            p, kind = rng.randrange(len(w) + 1), rng.random()
            if kind < 0.1 and p < len(w):
                w = w[:p] + rng.choice("abé") + w[p + 1:]
            elif kind < 0.2:
                w = w[:p] + rng.choice("abé") + w[p:]
            elif kind < 0.3:
                w = w[:p] + w[p + 1:]
            words.append(w)
        rows.append((i if i % 50 else None, " ".join(words)))
    # Chains: each form is the near word that occurs ten times as often.
    rows += [(2000 + i, f"chainon {'chainons ' * 10} {'Xchainons ' * 100}") for i in range(3)]
    return rows + [(5, None), (6, ""), (7, "x" * 3000), (8, "x" * 3000), (9, "x" * 3001), (10, "x" * 3001), (11, "a-few_short.words"),
                   (12, "repeated repeated"), (12, "repeated repeated")]


@pytest.mark.parametrize("limit", [200_000, 20, 1])
def test_variants_against_all_pairs(spark, limit):
    """Also with lists that are dealt anew, down to single positions."""
    rows = spelled_rows()
    got = spelling.spelling_variants(table(spark, [(k, t, "s") for k, t in rows]).repartition(3), limit=limit)
    want = variants(rows)
    assert by_text(map(tuple, got.collect())) == by_text(want)
    assert any(w[1] and w[1] != w[2] for w in want)


def test_variants_of_odd_rows(docs):
    got = spelling.spelling_variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert by_text(map(tuple, got.collect())) == by_text(variants(rows_of(docs)))


def test_scan_skips_no_near_word(monkeypatch):
    """Many small buffers of lanes give what one gives."""
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.choice([7, 8]))) for _ in range(1500)})
    first = np.zeros(len(words), bool)
    first[0] = True
    cls, low, high = (np.full(len(words), x) for x in (7, 0, 8))

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b) and min(len(a), len(b)) == 7}
    for lanes in (40_000, 100):
        monkeypatch.setattr(spelling, "LANES", lanes)
        got = spelling.scan(first, words, cls, low, high)
        assert len(got[0]) == len(want) and {*zip(got[0].tolist(), got[1].tolist())} == want


def test_no_rows_no_results(spark):
    none = table(spark, []).limit(0)
    for df in (token_counts.count_tokens(none), fill_middle.fill_middle(none), spelling.spelling_variants(none)):
        assert df.count() == 0
