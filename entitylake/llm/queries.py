"""The operators applied to the driver's tables, with SQL where SQL can check them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitylake.llm import (
    decontaminate,
    licenses,
    lines,
    merkle,
    oracles,
    packing,
    passages,
    quality,
    simhash,
    tokens,
    topk,
    toxicity,
    whitening,
    wrappers,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op2_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return tokens.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


@query
def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op3_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op1_top_k_search(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(table(spark, sf, "embeddings"))


ORACLES["op1_top_k_search"] = """
    WITH whole AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
        FROM embeddings
        WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
        FROM whole q JOIN whole c ON q.vec_id <> c.vec_id
        WHERE q.vec_id % 100 = 0
    )
    SELECT query_id, rank::INTEGER AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
    WHERE rank <= 10
"""


@query
def op6_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op9_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf, "pages").select("page_id", "url", "html"))


@query
def op4_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.without_repeats(table(spark, sf, "documents").select("doc_id", "text"))


@query
def op7_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op8_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf, "documents"))


@query
def op11_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitened(table(spark, sf, "embeddings"))


@query
def op12_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    proven = merkle.document_manifest(table(spark, sf, "documents"))
    proof = F.sha2(merkle.proof_text(F.col("path")), 256).alias("proof_sha256")
    return proven.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


ORACLES["op12_merkle_manifest"] = oracles.merkle_sql()


@query
def op13_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = passages.without_repeated_passages(table(spark, sf, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, span: n + span["length"]).alias("n_removed")
    return found.select("doc_id", "n_words", gone, F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op13_substring_dedup"] = oracles.PASSAGES
