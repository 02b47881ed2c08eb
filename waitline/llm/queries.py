"""Named queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waitline.llm import (exact_dedup, fill_middle, fingerprint, katz, licenses, lines, minhash, mixing, pieces, shards, spelling,
                          token_counts, toxicity)
from waitline.llm.common import remainder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_fingerprints(s, d):
    return fingerprint.edited_fingerprints(table(s, d, "documents"))


@query
def op2_exact_dedup(s, d):
    return exact_dedup.exact_groups(table(s, d, "documents"), keep="max")


@query
def op4_near_dedup(s, d):
    return minhash.near_duplicates(table(s, d, "documents"), shingle=2)


@query
def op5_license_scan(s, d):
    return licenses.scan_licenses(table(s, d, "documents"))


@query
def op6_line_dedup(s, d):
    return lines.drop_boilerplate(table(s, d, "pages"))


@query
def op8_pieces(s, d):
    return pieces.encode(table(s, d, "documents"))


@query
def op9_mixing(s, d):
    return mixing.mix(table(s, d, "documents")).drop("copies")


@query
def op10_toxicity(s, d):
    docs = table(s, d, "documents")
    held = remainder(F.col("doc_id"), 4) == 2
    model = toxicity.fit(docs.where(~held), table(s, d, "labels"))
    return toxicity.score_texts(docs, model).select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


@query
def op3_katz(s, d):
    docs = table(s, d, "documents")
    held = remainder(F.col("doc_id"), 7) == 2
    out = katz.score_documents(docs, ~held)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op7_training_order(s, d):
    return shards.write_shards(table(s, d, "documents"))


@query
def op11_token_counts(s, d):
    return token_counts.count_tokens(table(s, d, "documents"))


@query
def op12_fill_middle(s, d):
    out = fill_middle.fill_middle(table(s, d, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                      digest(fill_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


@query
def op13_spelling(s, d):
    return spelling.spelling_variants(table(s, d, "documents"))
