"""Corpus operators against brute force, on hand-made tables and on the small test tables."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from waitline.llm import (common, components, exact_dedup, fingerprint, katz, licenses, lines, minhash, mixing, pieces, queries, shards,
                          toxicity)
from waitline.sources.tables import workspace as common_workspace

SMALL = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, target double, taken long, n long, "
          "score double, h string, kept boolean")
BASE = ["the quick brown fox jumps over the lazy dog near the river bank today",
        "all rights reserved under the general public license version three of it",
        "Ünïcode wörds mit Umlaut und ß sind auch hier zu finden, 日本語 テキスト",
        "you are such an idiot and a worthless scum said the angry man again"]


def table(spark, rows):
    """Documents with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, None, s, 7, 1, 2.0, 3, 4, 0.5, "h", False) for i, t, s in rows], SCHEMA)


def odd_rows():
    """Nulls, empty, tiny and long texts, copies, repeated rows, a repeated id with another text."""
    rows = [(i, f"{BASE[i % 4]} {i // 4}", f"s{i % 3}") for i in range(40)]
    rows += [(100, None, "s1"), (101, "", None), (102, "one", "s2"), (103, "one two", None), (104, "  \t\n ", "s0"),
             (None, "a text without id", "s1"), (None, None, None), (105, BASE[0] + " 0", "s1"), (105, BASE[0] + " 0", "s1"),
             (106, BASE[1] + " 0", "s2"), (106, "other words under the same id", "s2"), (107, "x" * 5000, "s0"),
             (108, " ".join(f"w{i % 977}" for i in range(20_000)), "s0"), (109, "ONE", "s0"), (110, "a ▁ mark   and\n\nline ends", "s1")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, odd_rows()).repartition(3)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def words_of(text):
    return text.encode().lower().split()


# Fingerprints --------------------------------------------------------------------------------

@pytest.mark.parametrize("which", ["docs", "small"])
def test_edited_texts_and_next_documents(request, which):
    df = request.getfixturevalue(which)
    rows = sorted(texts_of(df), key=lambda r: (-(1 << 63) if r[0] is None else r[0], [-ord(c) for c in r[1][:200]]), reverse=True)
    if which == "docs":  # order among rows of one id is by text, ascending
        rows = sorted(texts_of(df), key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1]))
    expected = Counter()
    for k, (i, t) in enumerate(rows):
        following, third = rows[(k + 1) % len(rows)][1], len(t) // 3
        edited = t[:len(t) - third] + following[:third]
        expected[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
    got = fingerprint.edited_fingerprints(df).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == expected
    assert all(len(r.fingerprint) % 16 == 0 for r in got)
    # Likeness follows from the printed fingerprints; every kept hash is one of the text's shingles.
    split = lambda h: [h[i:i + 16] for i in range(0, len(h), 16)]

    def likeness(a, b):
        a, b = split(a), split(b)
        return 1.0 if a == b else len({*a} & {*b}) / min(len(a), len(b)) if a and b else 0.0

    shown = {(r.doc_id, r.n_chars, r.fingerprint) for r in got}
    for k, (i, t) in enumerate(rows):
        following, third = rows[(k + 1) % len(rows)][1], len(t) // 3
        sha = hashlib.sha256((t[:len(t) - third] + following[:third]).encode()).hexdigest()
        mine = [r for r in got if (r.doc_id, r.n_chars, r.edited_sha256) == (i, len(t), sha)]
        next_ids = {f for j, n, f in shown if j == rows[(k + 1) % len(rows)][0] and n == len(following)}
        assert all(r.near_edited == pytest.approx(likeness(r.fingerprint, r.edited_fingerprint)) for r in mine)
        assert all(any(r.near_next == pytest.approx(likeness(r.fingerprint, f)) for f in next_ids) for r in mine)


def test_sketches_hold_the_shingles_under_the_threshold(spark, docs):
    """Against shingles cut in Python and hashed one by one."""
    F = fingerprint.F
    rows = [t for _, t in texts_of(docs)]
    cut = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
    pieces_ = [(n, w[i:i + 5] if len(w) >= 5 else w) for n, w in enumerate(map(cut, rows)) for i in range(max(1, len(w) - 4) if w else 0)]
    hashed = spark.createDataFrame(pieces_, "n int, w array<string>").select("n", F.xxhash64("w").alias("h")).collect()
    limit = -(1 << 63) + (1 << 64) // fingerprint.FRACTION
    want = {n: sorted({r.h for r in hashed if r.n == n and r.h < limit}) for n in range(len(rows))}
    got = spark.createDataFrame(list(enumerate(rows)), "n int, text string").select("n", fingerprint.sketch(F.col("text")).alias("k"))
    assert {r.n: r.k for r in got.collect()} == want


@pytest.mark.parametrize("clusters", [False, True])
def test_next_document_over_many_blocks(spark, clusters):
    """Also with ids in clusters far apart, where an even cut would put nearly all into one block."""
    far = (lambda i: i + (i % 3 - 1) * 2 ** 62) if clusters else (lambda i: i)
    rows = [(far(i * 7919 % 10_007), f"text number {i}", "s") for i in range(1500)]
    df = table(spark, rows)
    got = {r.doc_id: r.next_text for r in fingerprint.with_next(df, per_block=10).collect()}
    order = sorted(rows, reverse=True)
    assert got == {a[0]: order[(k + 1) % len(order)][1] for k, a in enumerate(order)}
    placed = common.id_blocks(df, "doc_id", 10)(df).groupBy("_block").count().agg({"count": "max"}).first()[0]
    assert placed <= 40


def test_equal_texts_have_equal_fingerprints_and_estimates_follow_containment(spark):
    long = " ".join(f"w{i}" for i in range(4000))
    part = " ".join(f"w{i}" for i in range(400))
    df = table(spark, [(1, long, "s"), (2, part, "s"), (3, long, "s"), (4, "", "s"), (5, None, "s")])
    s = {r.doc_id: r.k for r in df.select("doc_id", fingerprint.sketch(fingerprint.F.coalesce("text", fingerprint.F.lit(""))).alias("k")).collect()}
    assert s[1] == s[3] and s[4] == s[5] == []
    assert set(s[2]) - set(s[1]) == set() and 60 < len(s[2]) < 140
    assert sorted(set(s[1]) | set(s[2])) == s[1]


def test_short_texts_are_found_in_a_long_one(spark):
    """Also texts of one shingle or less, most of which have no hash under the threshold."""
    words = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(40):
        n = 1 + k % 12
        rows += [(2 * k, " ".join(words), "s"), (2 * k + 1, " ".join(words[5 * k:5 * k + n]), "s")]
    rows += [(80, "", "s"), (81, "something else entirely", "s"), (82, "", "s")]
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(table(spark, rows)).collect()}
    assert all(got[i].exact_next == 1.0 for i in range(1, 80) if got[i].exact_next is not None or got[i].near_next < 1)
    assert sum(got[i].exact_next is not None for i in range(1, 80)) > 40
    assert got[81].exact_next == got[82].exact_next == 0 and got[80].exact_next == 0
    assert all(len(got[i].fingerprint) >= 16 for i in range(80)) and got[80].fingerprint == ""
    F = fingerprint.F
    pair = table(spark, [(k, f"{rows[2 * k + 1][1]}", "s") for k in range(40)]).select(
        fingerprint.merge(fingerprint.sketch(F.col("text")), fingerprint.sketch(F.lit(rows[0][1]))).alias("m"))
    whole = spark.range(1).select(fingerprint.sketch(F.lit(rows[0][1])).alias("m")).first().m
    short = [k for k in range(40) if 1 + k % 12 >= fingerprint.SHINGLE]
    merged = [r.m for r in pair.collect()]
    assert all(merged[k] == whole for k in short)


# Exact dedup ---------------------------------------------------------------------------------

@pytest.mark.parametrize("weak", [False, True])
def test_groups_of_equal_texts(docs, weak):
    digest = (lambda t: exact_dedup.F.substring(exact_dedup.F.unhex(exact_dedup.F.md5(t.cast("binary"))), 1, 1).cast("binary") if False
              else exact_dedup.F.crc32(t.cast("binary")).cast("long") % 4) if weak else exact_dedup.content_hash
    groups = {}
    for i, t in texts_of(docs):
        groups.setdefault(t, []).append(i)
    expected = Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            expected[i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
    got = exact_dedup.exact_groups(docs, digest=digest).collect()
    assert Counter(tuple(r) for r in got) == expected


def test_drop_copies_keeps_columns_and_one_row_of_each_text(docs):
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    assert Counter(t for _, t in texts_of(out)) == Counter(set(t for _, t in texts_of(docs)))


# Near-dedup ----------------------------------------------------------------------------------

def sets_of(rows, k):
    out = []
    for i, t in rows:
        w = words_of(t)
        out.append((i, {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()))
    return out


def brute_components(rows, k):
    sets = sets_of(rows, k)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        find(i if i is not None else -1)
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(i if i is not None else -1), find(j if j is not None else -1)))
                root[q] = p
    return {i: find(i if i is not None else -1) for i, _ in sets}, sets


@pytest.mark.parametrize("which,k", [("docs", 2), ("small", 2), ("small", 5)])
def test_near_copies_against_all_pairs(request, which, k):
    df = request.getfixturevalue(which)
    best, sets = brute_components(texts_of(df), k)
    got = minhash.near_duplicates(df, k).collect()
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, len(s)) for i, s in sets)
    for r in got:
        assert (r.component_id if r.component_id is not None else -1) == best[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)


def test_chains_in_large_groups_are_found(spark):
    words = [f"w{i}" for i in range(100)]
    rng = np.random.default_rng(5)
    rows = []
    for i in range(150):  # copies of one text with up to seven words changed
        w = list(words)
        for j in rng.choice(100, rng.integers(0, 8), replace=False):
            w[j] = f"x{i}_{j}"
        rows.append((i, " ".join(w), "s"))
    best, _ = brute_components([(i, t) for i, t, _ in rows], 2)
    got = minhash.near_duplicates(table(spark, rows), 2).collect()
    assert {r.doc_id: r.component_id for r in got} == best


def test_estimates_are_corrected_for_chance(spark):
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    values = [np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 100, dtype=np.uint64)])) for _ in range(2)]
    low = minhash.minima(np.concatenate(values), np.array([0, len(values[0])]))
    bits = minhash.packed(low).tolist()
    df = spark.createDataFrame([(*bits[0], *bits[1])], ", ".join(f"{x}{j} long" for x in "ab" for j in range(4)))
    named = df.selectExpr("named_struct('s0', a0, 's1', a1, 's2', a2, 's3', a3) a", "named_struct('s0', b0, 's1', b1, 's2', b2, 's3', b3) b")
    equal = ((low[0] & 3) == (low[1] & 3)).mean()
    assert named.select(minhash.estimate("a", "b")).first()[0] == pytest.approx((equal - 0.25) / 0.75)
    assert abs((equal - 0.25) / 0.75 - 900 / 1100) < 0.2


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5, 2000), (2000, 1), (7, 7)]
    got = {r.vertex: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{1000 + i: 1000 for i in range(60)}, 2000: 0}


# Katz ----------------------------------------------------------------------------------------

def brute_katz(rows, train):
    uni, bi, opened = Counter(), Counter(), Counter()
    for (i, t), learnt in zip(rows, train):
        w = [*words_of(t), "END"]
        if learnt:
            uni.update(w)
            bi.update(zip(["BEGIN", *w], w))
            opened.update(["BEGIN", *w[:-1]])
    n, v = sum(uni.values()), len(uni)
    d1, d2 = (katz.discounts([sum(x == r for x in c.values()) for r in range(1, 7)]) for c in (uni, bi))
    cut = lambda c, d: c * (1.0 if c > 5 else d[c])
    seen = sum(cut(c, d1) for c in uni.values())
    g = min(1.0, n * n / (n + 1) / seen) if seen else 1.0
    p = lambda w: g * cut(uni[w], d1) / n if uni[w] else (1 - g * seen / n if n else 1.0)
    s1, s2 = Counter(), Counter()
    for (h, w), c in bi.items():
        s1[h] += cut(c, d2)
        s2[h] += p(w)

    def prob(h, w):
        if not opened[h]:
            return p(w)
        k = min(1.0, opened[h] ** 2 / (opened[h] + 1) / s1[h])
        return k * cut(bi[h, w], d2) / opened[h] if bi[h, w] else (1 - k * s1[h] / opened[h]) / (1 - s2[h]) * p(w)

    out = []
    for i, t in rows:
        w = [*words_of(t), "END"]
        out.append((i, len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w),
                    sum(math.log10(prob(h, x)) for h, x in zip(["BEGIN", *w], w))))
    return out, prob, uni


@pytest.mark.parametrize("which,size", [("docs", 2000), ("small", 1 << 20), ("small", 30_000)])
def test_katz_scores(request, which, size, monkeypatch):
    df = request.getfixturevalue(which)
    rows = texts_of(df)
    held = lambda i: zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2
    expected, _, _ = brute_katz(rows, [not held(i) for i, _ in rows])
    train = queries.remainder(katz.F.col("doc_id"), 7) != 2
    got = katz.score_documents(df, train, size).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[5])
    for a, b in zip(sorted(expected, key=key), sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key),
                    strict=True):
        assert a[:4] == b[:4]
        assert b[4:] == pytest.approx(a[4:], rel=1e-9)


def test_katz_histories_sum_to_one(small):
    rows = texts_of(small)
    _, prob, uni = brute_katz(rows, [True] * len(rows))
    for h in ("BEGIN", b"the", b"de"):
        assert sum(prob(h, w) for w in uni) + prob(h, "never seen") == pytest.approx(1)


def test_katz_without_training_rows(docs):
    got = katz.score_documents(docs, katz.F.lit(False)).collect()
    assert len(got) == docs.count() and all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 for r in got)


def test_katz_texts_are_stored_once_whatever_the_blocks(spark, docs, monkeypatch):
    """Several blocks share a partition, a partition is one file, and no table stays behind."""
    rows = lambda df: sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.score, 9)) for r in df.collect())
    train = katz.F.col("doc_id") % 3 != 0
    expected = rows(katz.score_documents(docs, train, 500))
    folders = []
    monkeypatch.setattr(katz, "workspace", lambda s: folders.append(common_workspace(s)) or folders[-1])
    monkeypatch.setattr(katz, "PARTS", 3)
    assert rows(katz.score_documents(docs, train, 500)) == expected
    stored = spark.read.parquet(folders[0])
    assert len(stored.inputFiles()) <= 3 < stored.select("block").distinct().count()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("katz_")]


# Licences ------------------------------------------------------------------------------------

def test_license_phrases_against_a_plain_search(docs, small):
    for df in (docs, small):
        expected = Counter()
        for i, t in texts_of(df):
            w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().lower())
            places, labels = [], set()
            for phrase, label in licenses.PHRASES.items():
                p = phrase.encode().split()
                found = [k for k in range(len(w)) if w[k:k + len(p)] == p]
                places += found
                labels |= {label} if found else set()
            expected[i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))] += 1
        got = licenses.scan_licenses(df).collect()
        assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == expected
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_matching_statistics_against_substrings():
    rng = np.random.default_rng(2)
    templates = [rng.integers(1, 4, 12).tolist() for _ in range(3)]
    known = {tuple(t[a:b]) for t in templates for a in range(12) for b in range(a + 1, 13)}
    a = licenses.Automaton(templates)
    for _ in range(40):
        text = rng.integers(1, 5, 30).tolist()
        longest = [max((n for n in range(1, k + 2) if tuple(text[k + 1 - n:k + 1]) in known), default=0) for k in range(30)]
        runs = [(stop, n) for stop, n, _ in a.matches(text, 0, 30)]
        expected = [(k + 1, n) for k, n in enumerate(longest) if n and (k == 29 or longest[k + 1] <= n)]
        assert runs == expected
        for stop, n, state in a.matches(text, 0, 30):
            ends = {(i, e) for i, t in enumerate(templates) for e in range(n - 1, 12) if t[e + 1 - n:e + 1] == text[stop - n:stop]}
            assert a.ends[state] == ends


def test_changed_licence_text_is_still_found(spark):
    mit = licenses.TEMPLATES[0][1].split()
    changed = " ".join(["Intro."] + mit[:12] + ["oops"] + mit[13:] + ["and more"])
    r = licenses.scan_licenses(table(spark, [(1, changed, "s")])).first()
    assert r.labels == "mit" and 0.9 < r.score < 1
    assert [s.start for s in r.spans if s.label == "mit"][0] == 1


def test_later_paragraphs_and_whole_licence_texts(spark):
    """Each text as a whole, and a document that holds one later paragraph only, with a few words changed."""
    rows, expected = [], {}
    for label, name in licenses.WHOLE:
        text = licenses.whole_text(name)
        rows.append((len(rows), text, "s"))
        expected[len(rows) - 1] = (label, len(licenses.scan_words(text)), 0)
        part = [w.decode() for w in licenses.passages(text)[-2 if name in ("MIT", "BSD") else -1]]
        rows.append((len(rows), " ".join(["intro", "words", "xyzzy", *part[:9], "oops", *part[9:], "plugh"]), "s"))
        expected[len(rows) - 1] = (label, len(part), 3)
    rows.append((len(rows), "We met on the river bank and the terms of the day were good for a walk to the house of the old man.", "s"))
    got = {r.doc_id: r for r in licenses.scan_licenses(table(spark, rows)).collect()}
    for i, (label, n, start) in expected.items():
        assert label in got[i].labels.split(","), (i, label, got[i].labels)
        span = max((s for s in got[i].spans if s.label == label), key=lambda s: s.stop - s.start)
        assert span.stop - span.start >= 0.9 * n and span.cover >= 0.9, (i, label, span)
        assert span.start == start, (i, label, span)
    assert got[len(rows) - 1].labels == "" and got[len(rows) - 1].score < licenses.COVER


def test_shared_passages_give_the_label_of_the_longer_text(spark):
    names = {"GPL-2": "gpl", "GPL-3": "gpl", "Apache-2.0": "apache-2.0", "MIT": "mit", "ISC": "isc", "CC0-1.0": "cc0", "EPL-1.0": "epl"}
    notice = next(t for label, t in licenses.TEMPLATES if label == "agpl")
    rows = [(0, notice, "s"), *((k + 1, licenses.whole_text(n), "s") for k, n in enumerate(names))]
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(table(spark, rows)).collect()}
    # The fixed phrase "general public license" stands in the AGPL's name as well.
    assert got == {0: "agpl,gpl"} | {k + 1: label for k, label in enumerate(names.values())}


# Lines ---------------------------------------------------------------------------------------

def test_boilerplate_lines_per_host(spark):
    page = lambda own, extra="": f"<html><script>x</script><p>menu</p>{extra}<p>{own}</p><!-- note --><p>foot</p></html>"
    rows = [(i, "http://a.example/x" + str(i), page(f"own {i}", "<p>rare</p>" if i == 0 else "")) for i in range(10)]
    rows += [(20, "https://B.example", page("single")), (21, None, page("no host")), (22, "http://c.example", None), (23, "", ""),
             (None, "http://a.example/y", page("own 3")), (3, "http://a.example/x3", page("own 3"))]
    got = lines.drop_boilerplate(spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, lines int"), ratio=0.3).collect()
    assert len(got) == len(rows)
    by = Counter((r.page_id, r.host, r.n_lines, r.n_dropped, r.text) for r in got)
    assert by[0, "a.example", 4, 2, "rare\nown 0"] == 1 and by[3, "a.example", 3, 2, "own 3"] == 2
    assert by[20, "b.example", 3, 0, "menu\nsingle\nfoot"] == 1 and by[21, "", 3, 0, "menu\nno host\nfoot"] == 1
    assert by[22, "c.example", 0, 0, ""] == 1 and by[23, "", 0, 0, ""] == 1


def test_lines_of_a_page():
    """Against the plain pattern on short pages, and in little time on long ones with unclosed marks."""
    import time

    hidden = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.I | re.S | re.A)
    rng = np.random.default_rng(5)
    bits = ["<!--", "-->", "<script>", "</script>", "<STYLE a>", "</style >", "<p>", "text ", "\n", "<", ">", " b", "<scripted>", "<b"]
    for _ in range(3000):
        html = "".join(rng.choice(bits, rng.integers(0, 14)))
        plain = [x.strip(" ") for x in re.split(r"<[^>]*>|\n", hidden.sub("\n", html))]
        assert lines.lines_of(html) == [x for x in plain if x], html
    for bad in ("<!-- x ", "<script ", "<style", "<", "<b ", "<!-- <script <style "):
        start = time.time()
        lines.lines_of(bad * (1_000_000 // len(bad)))
        lines.lines_of("<p>a</p>" + bad * (1_000_000 // len(bad)) + "<p>b</p>")
        assert time.time() - start < 5, bad


def test_boilerplate_against_plain_counts(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(300):
        site = f"h{int(rng.integers(12)) ** 2 % 11}"
        body = "".join(f"<p>{w}</p>" for w in rng.choice(["menu", "foot", "ad", *[f"t{k}" for k in range(60)]], rng.integers(0, 9)))
        rows.append((i % 290, None if i % 50 == 0 else f"https://{site}.example/{i}", None if i % 70 == 0 else body + "<!-- menu --> x"))
    got = Counter(map(tuple, lines.drop_boilerplate(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()))
    cut = [(k, "" if u is None else u.split("/")[2], lines.lines_of(h or "")) for k, u, h in rows]
    total, seen = Counter(h for _, h, _ in cut), Counter((h, x) for _, h, ls in cut for x in {*ls})
    want = Counter()
    for k, h, ls in cut:
        stay = [x for x in ls if not (seen[h, x] >= 2 and seen[h, x] > 0.1 * total[h])]
        want[k, h, len(ls), len(ls) - len(stay), "\n".join(stay)] += 1
    assert got == want


def test_a_host_of_two_pages_loses_its_menu(spark):
    rows = [(k, f"http://two.example/{k}", f"<p>menu</p><p>own {k}</p><p>foot</p>") for k in range(2)] + [(2, "http://one.example", "<p>menu</p>")]
    got = lines.drop_boilerplate(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.n_dropped, r.text) for r in got} == {(0, 2, "own 0"), (1, 2, "own 1"), (2, 0, "menu")}


# Shards --------------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_slots_are_a_permutation(n):
    slots = shards.permute(np.arange(n), n)
    assert sorted(slots) == list(range(n))
    assert (shards.permute(slots, n, inverse=True) == np.arange(n)).all()
    assert n < 64 or (slots != shards.permute(np.arange(n), n, key=9)).any()


def test_ids_decode_to_the_text():
    with open(shards.VOCABULARY, "rb") as f:
        e = shards.encoder(f.read())
    for text in ["", " ", "a", " a b", "a   b", "x\n y", "é  ü\n\n z", "don't stop 12 34!? ", "日本 語  ", "ab" * 9000]:
        assert e.decode(np.frombuffer(e.encode(text), np.uint16)).decode() == text


def test_shards_hold_every_document_once(docs, tmp_path):
    folder = str(tmp_path / "out")
    rows = shards.write_shards(docs, folder, length=64, per_shard=100).toPandas().sort_values("slot")
    n = len(rows)
    assert rows["slot"].tolist() == list(range(n))
    data = shards.read_from(folder, 0, n + 5, 64, 100)
    assert [hashlib.sha256(x.tobytes()).hexdigest() for x in data] == rows["sha256"].tolist()
    assert (shards.read_from(folder, 150, 120, 64, 100) == data[150:270]).all()
    stream = data[shards.permute(np.arange(n), n)].ravel()
    with open(shards.VOCABULARY, "rb") as f:
        e = shards.encoder(f.read())
    stream = stream[:rows["n_tokens"].sum()]
    ends = np.flatnonzero(stream == e.end)
    found = Counter(e.decode(part[:-1] if len(part) else part).decode() for part in np.split(stream, ends + 1) if len(part))
    assert found == Counter(t for _, t in texts_of(docs))
    assert Counter(i for ids in rows["doc_ids"] for i in ids) == Counter(i for i, _ in texts_of(docs))


def test_shards_do_not_depend_on_splits(spark, tmp_path):
    """The same files read in few or many splits, and by other numbers of tasks, give the same sequences."""
    rows = [(i, f"{BASE[i % 4]} number {i} " * (1 + i % 30), f"s{i % 3}") for i in range(3000)]
    table(spark, rows).repartition(5).write.option("parquet.block.size", 20_000).parquet(f"{tmp_path}/docs")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    found = []
    try:
        for size, cost in (("128m", "4m"), ("1m", "1k"), ("8k", "1k")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
            df = spark.read.parquet(f"{tmp_path}/docs")
            folder = f"{tmp_path}/out-{size}"
            out = shards.write_shards(df, folder, length=64, per_shard=500).collect()
            assert {r.folder for r in out} == {folder}
            found.append((df.rdd.getNumPartitions(), {(r.slot, r.sequence, r.sha256, tuple(r.doc_ids)) for r in out}))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found[0][0] < found[2][0] and found[0][1] == found[1][1] == found[2][1] and len(found[0][1]) > 1000


# Pieces --------------------------------------------------------------------------------------

def unigram_library(m):
    """The same pieces and scores in the library's own lattice search: kind and scores of the model file set anew."""
    import sentencepiece

    proto, at, out, number = pieces.read_model(), 0, b"", 0
    scores = {i: s / pieces.UNITS for s, i in m.known.values()}

    def varint(i):
        value = shift = 0
        while True:
            value |= (proto[i] & 127) << shift
            shift += 7
            i += 1
            if proto[i - 1] < 128:
                return value, i

    def put(x):
        parts = []
        while x > 127:
            parts.append(x & 127 | 128)
            x >>= 7
        return bytes([*parts, x])

    while at < len(proto):
        tag, body = varint(at)
        size, start = varint(body)
        part = proto[start:start + size]
        if tag >> 3 == 1:  # a piece; the last value of a field holds
            part += b"\x15" + struct.pack("<f", scores.get(number, 0.0))
            number += 1
        if tag >> 3 == 2:
            part += b"\x18\x01"  # kind 1
        out += put(tag) + put(len(part)) + part
        at = start + size
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def test_encoding_equals_the_library_search(docs, small):
    m = pieces.pieces(pieces.read_model())
    sp, scores = unigram_library(m), {i: s / pieces.UNITS for s, i in m.known.values()}
    score = lambda ids: sum(scores.get(i, 0.0) for i in ids)
    same = 0
    for df in (docs, small):
        texts = {t for _, t in texts_of(df)}
        for t in texts:
            ours, theirs = np.frombuffer(m.encode(t), np.int32).tolist(), sp.encode(t)
            same += ours == theirs
            # The library adds up single precision; sums that are equal there may differ here.
            assert ours == theirs or 0 <= score(ours) - score(theirs) < 0.01, t[:100]
    assert same > 0.8 * len(texts)


@pytest.mark.parametrize("chunk", [7, 40, 1000])
def test_cut_texts_encode_like_whole_ones(docs, chunk):
    rows = [(i, t) for i, t in texts_of(docs) if len(t) < 200 or chunk == 1000]
    m = pieces.pieces(pieces.read_model())
    expected = Counter((i, tuple(np.frombuffer(m.encode(t), np.int32).tolist()), t.replace("▁", " ") == t) for i, t in rows)
    part = docs if chunk == 1000 else docs.where("coalesce(length(text), 0) < 200")
    got = pieces.encode(part, chunk=chunk).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.round_trip) for r in got) == expected


def test_chunk_matrices_multiply_associatively():
    """Any bracketing gives the same product, and its first row is the scan from the text's start."""
    m = pieces.pieces(pieces.read_model())
    text = pieces.SPACE + "theinternationalizationofthings,overandover".replace(" ", pieces.SPACE) * 3
    parts = [text[i:i + 9] for i in range(0, len(text), 9)]
    mats = [m.matrix(p, text[(i + 1) * 9:(i + 1) * 9 + m.longest - 1]) for i, p in enumerate(parts)]
    left, right = mats[0], mats[-1]
    for x in mats[1:]:
        left = pieces.max_plus(left, x)
    for x in mats[-2::-1]:
        right = pieces.max_plus(x, right)
    assert (left == right).all()
    assert left[0, 0] == m.forward(text, {0: 0.0}, len(text))[0][-1]
    flat = [x.ravel().tolist() for x in mats]
    assert pieces._product(flat, m.longest) == left.ravel().tolist()


@pytest.mark.parametrize("fan", [2, 3])
def test_a_text_of_many_levels(spark, monkeypatch, fan):
    monkeypatch.setattr(pieces, "FAN", fan)
    m = pieces.pieces(pieces.read_model())
    rows = [(1, "the internationalisation of things " * 20), (2, "x" * 400), (3, "日本語テキスト" * 60), (4, " " * 300), (1, "short but cut")]
    got = pieces.encode(table(spark, [(k, t, "s") for k, t in rows]), chunk=11).collect()
    want = Counter((k, tuple(np.frombuffer(m.encode(t), np.int32).tolist())) for k, t in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want


def test_boundaries_agree_with_the_merging_library(small):
    """The share of piece boundaries that the model's own merging sets too, as the README states it."""
    import sentencepiece

    m = pieces.pieces(pieces.read_model())
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    both = mine = theirs = 0
    for _, t in texts_of(small):
        ends = lambda ids: {*np.cumsum([len(m.raw[i]) for i in ids]).tolist()}
        a, b = ends(np.frombuffer(m.encode(t), np.int32).tolist()), ends(sp.encode(t))
        both, mine, theirs = both + len(a & b), mine + len(a), theirs + len(b)
    assert 0.88 < both / theirs < 0.95 and 0.98 < mine / theirs < 1.0


def test_decoding_gives_the_text_back(small):
    got = {r.doc_id: r.text for r in pieces.decode(pieces.encode(small)).collect()}
    assert got == dict(texts_of(small))


# Mixing --------------------------------------------------------------------------------------

def test_targets_stop_at_three_sizes():
    goal = mixing.targets([("a", 10), ("b", 1000), (None, 500)])
    assert goal["a"] == 30 and goal["b"] + goal[None] == pytest.approx(1480)
    assert goal["b"] / goal[None] == pytest.approx(2)
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}


def test_flow_is_cheapest_for_overlapping_sources():
    # Pattern 0 only in a, 1 in both, 2 only in b: what both list goes where repeats would be needed.
    flow = mixing.min_cost_flow({0: 10, 1: 10, 2: 10}, {"a": 10, "b": 20}, {0: ["a"], 1: ["a", "b"], 2: ["b"]})
    assert flow == {(0, "a"): 10, (1, "b"): 10, (2, "b"): 10}
    flow = mixing.min_cost_flow({0: 5}, {"a": 100}, {0: ["a"]})
    assert flow == {(0, "a"): 15}


@pytest.mark.parametrize("which", ["docs", "small"])
def test_mix_meets_its_targets(request, which):
    df = request.getfixturevalue(which)
    first, second = mixing.mix(df).collect(), mixing.mix(df.repartition(5)).collect()
    assert Counter(first) == Counter(second) and len(first) == df.count()
    source = Counter((r.doc_id, len((r.text or "").encode().split()), r.source) for r in df.select("doc_id", "text", "source").collect())
    assert Counter((r.doc_id, r.size) for r in first) == Counter((i, n) for i, n, _ in source.elements())
    assert all(0 <= r.taken <= 3 * r.size and r.copies == math.ceil(r.taken / max(1, r.size)) for r in first)
    taken, goal = Counter(), {}
    for r in first:
        taken[r.source_size, r.target] += r.taken
        goal[r.source_size, r.target] = r.target
    same = Counter({(r.source_size, r.target): 0 for r in first})
    sizes = Counter()
    for i, n, s in source.elements():
        sizes[s] += n
    for s, n in sizes.items():
        same[n, mixing.targets(list(sizes.items()))[s]] += 1
    for k, n in taken.items():
        assert n == pytest.approx(same[k] * goal[k], abs=1.0 * same[k])


def test_materialised_mix_repeats_whole_rows(docs):
    out = mixing.materialise(docs)
    assert out.columns == docs.columns
    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == +copies
    assert {t for _, t in texts_of(out)} <= {t for _, t in texts_of(docs)}


def test_overlapping_sources(spark):
    df = table(spark, [(i, "w " * 10, "x") for i in range(30)])
    lists = mixing.F.when(mixing.F.col("doc_id") < 10, mixing.F.array(mixing.F.lit("a"))).otherwise(mixing.F.array(mixing.F.lit("b"), mixing.F.lit("a")))
    got = mixing.mix(df, lists).collect()
    assert sum(r.taken for r in got) == pytest.approx(500, abs=2)  # both sources' sizes


def test_every_share_goes_through_the_flow(spark, monkeypatch):
    """Also that of a source which no other one overlaps."""
    seen = []
    real = mixing.min_cost_flow
    monkeypatch.setattr(mixing, "min_cost_flow", lambda *a: seen.append(a) or real(*a))
    links = [{"pattern": 7, "words": 10, "node": "sa", "size": 10, "target": 25.0}]
    assert mixing._solved(links, mixing.COSTS) == [{"pattern": 7, "rounds": 2, "rest": 5, "source_size": 10, "target": 25.0}]
    assert len(seen) == 1


def test_thirty_thousand_overlapping_patterns(spark):
    """In ten thousand components: a, a and b, b; each source comes near its target."""
    F = mixing.F
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"))
    name = lambda side: F.concat(F.lit(side), F.floor(F.col("doc_id") / 3).cast("string"))
    lists = F.when(F.col("doc_id") % 3 == 0, F.array(name("a"))).when(F.col("doc_id") % 3 == 1, F.array(name("a"), name("b"))).otherwise(F.array(name("b")))
    out = mixing.mix(df, lists)
    assert out.count() == 30_000 and out.where("taken > 3 * size").isEmpty()
    # What a component's three documents give is the most that its two targets can take of them.
    whole = out.withColumn("c", F.floor(F.col("doc_id") / 3)).groupBy("c").agg(
        F.sum("taken").alias("taken"), F.sum(F.when(F.col("doc_id") % 3 != 1, F.round("target"))).alias("target"), F.sum(3 * F.col("size")).alias("most"))
    assert whole.where("abs(taken - least(target, most)) > 2").isEmpty()


def test_more_sources_than_the_driver_takes(spark, monkeypatch):
    """The same mix with targets found by joins."""
    F = mixing.F
    df = table(spark, [(i, "w " * (1 + i * i % 37 * (20 if i % 40 == 3 else 1)), None if i % 40 == 7 else f"s{i % 40}") for i in range(400)])
    lists = F.when(F.col("doc_id") % 40 == 5, F.array(F.lit("s5"), F.lit("s6"))).otherwise(F.array("source"))
    for sources in (None, lists):
        expected = Counter(mixing.mix(df, sources).collect())
        monkeypatch.setattr(mixing, "NODES", 5)
        assert Counter(mixing.mix(df, sources).collect()) == expected
        monkeypatch.undo()
    sizes = Counter()
    for i, t, source in df.select("doc_id", "text", "source").collect():
        sizes[source] += len(t.split())
    goal = mixing.targets(list(sizes.items()))
    assert any(goal[s] == 3 * n for s, n in sizes.items()) and any(goal[s] < n for s, n in sizes.items())
    taken = Counter()
    for r, in mixing.mix(df).join(df.select("doc_id", "source"), "doc_id").select(F.struct("source", "taken")).collect():
        taken[r.source] += r.taken
    assert taken == {s: round(goal[s]) for s in sizes}


# Toxicity ------------------------------------------------------------------------------------

def toxic_table(spark, n=400):
    rng = np.random.default_rng(0)
    syllables = ["ta", "ri", "mo", "len", "su", "ka", "per", "di", "no", "vel"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = [word() for _ in range(30)]
        if bad:
            w[int(rng.integers(30))] = ["grobzak", "plonkert", "wuffelbix"][i % 3]
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(bad)))
    return rows, spark.createDataFrame([*labels, (n + 50, 1), (None, 0), (5000, None)], "doc_id long, toxic int")


def test_insults_are_found_also_with_gaps(spark):
    rows, labels = toxic_table(spark)
    df = table(spark, rows)
    model = toxicity.fit(df.where("doc_id < 300"), labels)
    got = {r.doc_id: r for r in toxicity.score_texts(df, model).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(300, 400))
    odd = ["a grob-zak here", "a g r o b z a k here", "a grobbzak here", "pl.onk.ert", "tari molensu kaper", None, "", "...", "grobzak" + " ta ri" * 30_000,
           "ta" * 9000]
    got = {r.doc_id: r for r in toxicity.score_texts(table(spark, [(i, t, "s") for i, t in enumerate(odd)]), model).collect()}
    assert [got[i].predicted for i in range(len(odd))] == [1, 1, 1, 1, 0, 0, 0, 0, 1, 0]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[5].score == got[6].score == 0


def test_insults_in_other_scripts(spark):
    """Letters outside ASCII are told apart."""
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(["ма", "ло", "ри", "те", "нку", "со"], rng.integers(1, 4)))
    rows = [(i, " ".join([word() for _ in range(20)] + (["дурбень"] if i % 4 == 0 else [])), "s") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(table(spark, rows).where("doc_id < 300"), labels)
    extra = [(1000, "мало рите дур-бень", "s"), (1001, "мало рите нкусо", "s"), (1002, "аааааа мммм", "s")]
    got = {r.doc_id: r.predicted for r in toxicity.score_texts(table(spark, rows + extra), model).collect()}
    assert all(got[i] == int(i % 4 == 0) for i in range(300, 400))
    assert (got[1000], got[1001], got[1002]) == (1, 0, 0)


def test_rows_are_rejected_by_their_own_text(spark):
    """Rows without an id, or with one that other rows share, and whole rows that repeat."""
    rows, labels = toxic_table(spark)
    clean, toxic = "tari molensu kaper", "tari grobzak kaper"
    extra = [(None, toxic, "s"), (None, clean, "s"), (6000, toxic, "s"), (6000, clean, "s"), (6001, clean, "s"), (6001, clean, "s"), (None, None, None)]
    df = table(spark, rows + extra)
    kept = toxicity.reject(df, labels)
    assert kept.columns == df.columns
    left = [(r.doc_id, r.text) for r in kept.collect() if r.doc_id is None or r.doc_id >= 6000]
    assert sorted(left, key=str) == sorted([(None, clean), (6000, clean), (6001, clean), (6001, clean), (None, None)], key=str)
    scores = {(r.doc_id, r.predicted) for r in toxicity.score_texts(df, toxicity.fit(df, labels)).collect() if r.doc_id == 6000}
    assert scores == {(6000, 0), (6000, 1)}


def test_pairs_with_and_without_the_insult_are_both_learnt(spark):
    """Near copies are passed over within one label only."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(["ta", "ri", "mo", "len", "su", "ka", "per", "di"], rng.integers(2, 5)))
    base = [" ".join(word() for _ in range(25)) for _ in range(100)]
    rows = [(2 * i, t, "s") for i, t in enumerate(base)] + [(2 * i + 1, t + " grobzak", "s") for i, t in enumerate(base)]
    words = sorted({w for _, t, _ in rows for w in t.split()})
    bags = [np.array(sorted(words.index(w) for w in {*t.split()})) for _, t, _ in rows]
    hashes = np.array([toxicity.hash_of(w) for w in words], np.uint64)
    kept = toxicity.distinct(bags, hashes, np.array([k % 2 for k, _, _ in rows]))
    assert sum(rows[i][0] % 2 for i in kept) > 90 and sum(1 - rows[i][0] % 2 for i in kept) > 90
    assert len(toxicity.distinct(bags + bags, hashes, np.array([k % 2 for k, _, _ in rows] * 2))) == len(kept)
    labels = spark.createDataFrame([(k, k % 2) for k, _, _ in rows], "doc_id long, toxic int")
    df = table(spark, rows)
    got = {r.doc_id: r.predicted for r in toxicity.score_texts(df, toxicity.fit(df, labels)).collect()}
    assert all(got[k] == k % 2 for k, _, _ in rows)


def test_scores_against_a_plain_restatement(spark):
    """The score of a text is the logistic of its most toxic word, summed subsequence by subsequence."""
    rows, labels = toxic_table(spark)
    df = table(spark, rows)
    model = toxicity.fit(df, labels)
    values = dict(zip(model.keys.tolist(), model.values.tolist()))
    symbol = lambda c: ord(c) - 96 if c.islower() else 27 + int(c)

    def word_score(w):
        s = [toxicity.OPEN, *map(symbol, w), toxicity.CLOSE]
        total = sum(toxicity.DECAY ** (k - i + 1) * values.get((s[i] * 128 + s[j]) * 128 + s[k], 0.0)
                    for i in range(len(s)) for j in range(i + 1, len(s)) for k in range(j + 1, min(len(s), i + toxicity.SPAN)))
        return total / _norm(w) + model.bias

    got = {r.doc_id: r.score for r in toxicity.score_texts(df, model).collect()}
    for key, text, _ in rows[:60]:
        top = max(word_score(w) for w in text.split())
        assert got[key] == pytest.approx(1 / (1 + math.exp(-(model.slope * top + model.shift))), abs=1e-6)


def test_labels_that_no_word_tells_apart_give_no_model(spark):
    df = table(spark, [(i, "the same words", "s") for i in range(20)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    with pytest.warns(UserWarning, match="every score is 0"):
        assert toxicity.fit(df, labels) is None
    assert toxicity.reject(df, labels).count() == 20


def test_kernel_table_equals_subsequence_sums():
    x, z = "grobzak", "grobxzak"
    weights = lambda s: Counter({u: 0.0 for u in ()}) if not s else _subsequences(s)
    a, b = weights(x), weights(z)
    dot = sum(a[u] * b[u] for u in a)
    table_ = toxicity.landmark_tables([z])
    assert toxicity.project([x], table_)[0, 0] == pytest.approx(dot / (_norm(x) * _norm(z)))


def _subsequences(s):
    s = "^" + s + "$"
    out = Counter()
    for i in range(len(s)):
        for j in range(i + 1, len(s)):
            for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                out[s[i] + s[j] + s[k]] += toxicity.DECAY ** (k - i + 1)
    return out


def _norm(s):
    n = len(s) + 2
    return math.sqrt(sum(toxicity.DECAY ** (2 * (k - i + 1)) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + toxicity.SPAN))))


def test_without_labels_nothing_is_toxic(spark, docs):
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels) is None
    got = toxicity.score_texts(docs, None).collect()
    assert len(got) == docs.count() and all(r.score == 0 and r.predicted == 0 for r in got)


# Empty tables --------------------------------------------------------------------------------

def test_empty_tables_give_empty_results(spark):
    empty = table(spark, [(1, "x", "s")]).where("doc_id = 2")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    results = [fingerprint.edited_fingerprints(empty), exact_dedup.exact_groups(empty), exact_dedup.drop_copies(empty),
               katz.score_documents(empty, katz.F.lit(True)), minhash.near_duplicates(empty), minhash.drop_near_copies(empty),
               licenses.scan_licenses(empty), lines.drop_boilerplate(pages), shards.write_shards(empty), pieces.encode(empty),
               pieces.encode(empty, chunk=5), mixing.mix(empty), mixing.materialise(empty), toxicity.score_texts(empty, toxicity.fit(empty, labels)),
               toxicity.reject(empty, labels)]
    for df in results:
        assert df.collect() == []
