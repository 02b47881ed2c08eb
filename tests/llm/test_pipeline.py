"""Every stage of the pipeline on a small corpus against plain restatements, and the whole run."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from test_operators import brute_components, table, texts_of, toxic_table, words_of
from waitline.llm import minhash, mixing, pieces, toxicity

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean and toxic texts over three sources, with exact and near copies, nulls and empty texts."""
    rows, labels = toxic_table(spark, 240)
    rows = [(i, t, f"s{i % 3}") for i, t, _ in rows]
    rows += [(1000 + i, rows[i][1], "s0") for i in (1, 2, 3, 5, 4)]
    rows += [(2000 + i, rows[i][1] + " final", "s1") for i in (6, 7, 9, 10, 8)]
    rows += [(3000, None, "s0"), (3001, "", None), (3002, "tari " * 50_000, "s2"), (None, "mo len su ka", "s1")]
    folder = str(tmp_path_factory.mktemp("corpus"))
    table(spark, rows).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_against_plain_restatements(spark, corpus):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    kept = []
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, corpus)
        if name != "sentencepiece":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
            out.write.parquet(f"{corpus}/{name}.parquet")
            out = spark.read.parquet(f"{corpus}/{name}.parquet")
        kept.append((docs, out))
        docs = out
    before, after = (texts_of(x) for x in kept[0])
    model = toxicity.fit(kept[0][0], spark.read.parquet(f"{corpus}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score_texts(kept[0][0], model).collect() if r.predicted}
    assert Counter(after) == Counter(x for x in before if x[0] not in bad)
    insult = [any(w in t for w in ("grobzak", "plonkert", "wuffelbix")) for _, t in before]
    assert [x[0] in bad for x in before] == insult
    before, after = (texts_of(x) for x in kept[1])
    least = {}
    for i, t in before:
        least[t] = min((x for x in (i, least.get(t)) if x is not None), default=None)
    assert Counter(after) == Counter((i, t) for t, i in least.items())
    before, after = (texts_of(x) for x in kept[2])
    best, _ = brute_components(before, 5)
    assert Counter(i for i, _ in after) == Counter(i for i, _ in before if best[i] == (i if i is not None else -1))
    before, after = (texts_of(x) for x in kept[3])
    copies = Counter()
    for r in mixing.mix(kept[3][0]).collect():
        copies[r.doc_id] += r.copies
    assert Counter(i for i, _ in after) == +copies
    assert all(n <= 3 for n in copies.values())
    words = {i: len(words_of(t)) for i, t in before}
    total, mixed = sum(words.values()), sum(words[i] * n for i, n in copies.items())
    assert abs(mixed - total) <= 4 * max(words.values())
    m = pieces.pieces(pieces.read_model())
    encoded = Counter((r.doc_id, tuple(r.ids)) for r in kept[4][1].collect())
    assert encoded == Counter((i, tuple(np.frombuffer(m.encode(t), np.int32).tolist())) for i, t in texts_of(kept[4][0]))


def test_run_is_the_stages_in_order(spark, corpus):
    got = corpus_pipeline.run(spark, corpus)
    assert Counter(r.doc_id for r in got.collect()) == Counter(
        r.doc_id for r in spark.read.parquet(f"{corpus}/mixing.parquet").collect())
    assert all(r.round_trip for r in got.collect())


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    docs = table(spark, [(1, "x", "s")]).where("doc_id = 2")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, folder)
        assert docs.count() == 0
    table(spark, [(1, "x", "s")]).where("doc_id = 2").write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_registered_queries():
    names = entry.queries()
    numbered = [m[1] for n in names if (m := re.match(r"op(\d+)_", n))]
    assert "pipeline" in names and sorted(map(int, numbered)) == [*range(1, 14)]
    assert set(entry.oracle_sql()) <= set(names)


def test_statements_equal_their_queries(spark):
    from check_oracles import compare, connect

    from waitline.llm.oracle import ORACLES

    for name, sql in ORACLES.items():
        assert compare(entry.queries()[name](spark, SMALL).toPandas(), connect(SMALL).execute(sql).df()) == "ok"


def test_python_workers_get_texts_in_small_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = table(spark, [(i, "tari " * 20_000, "s0") for i in range(100)]).coalesce(1)
    minhash.signatures(docs, 5)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 9 << 20 and max(found) < 5 << 20
