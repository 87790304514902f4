"""The registered queries of this subpackage, each over its whole table.

SQL can't express them: components, tokenizers, range coding, expectation-maximisation, learned lexicons and filters, and
packing are no joins or aggregates of the tables. tests/llm holds each against brute force, the library or a round trip.
Only exact top-k search has SQL.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, embed_dedup, language_id, ngram_join, packing, pii, substring_dedup, token_store, topk_search, toxicity
from tessella.llm.common import load

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def _fold(parts: int) -> str:
    return f"pmod(crc32(cast(doc_id AS string)), {parts})"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(spark, load(spark, sf_dir, "documents"), k=4, percent=85)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode_digests(spark, load(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored_tokens(spark, load(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), end_id=0)


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(spark, load(spark, sf_dir, "embeddings"), cosine=0.95)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(spark, load(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_report(spark, load(spark, sf_dir, "documents"), window=20)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn(spark, docs, load(spark, sf_dir, "labels").where(f"{_fold(3)} <> 1"))
    scored = toxicity.score_texts(spark, docs, lexicon)
    return scored.select("doc_id", F.expr(f"{_fold(3)} = 1").alias("held_out"), "score", F.expr("if(score >= 0.7, 1, 0)").alias("predicted"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_vectors(spark, load(spark, sf_dir, "embeddings"), every=50, k=5)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = language_id.learn(spark, docs.where(f"{_fold(5)} <> 0"))
    return language_id.predict(spark, docs, filters).select("doc_id", F.expr(f"{_fold(5)} = 0").alias("held_out"), "lang_pred", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, load(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=2, keep_ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_ngram_jaccard_join, op2_bpe_round_trip, op3_token_store, op4_embedding_near_dedup, op5_pii, op6_substring_dedup, op7_toxicity, op8_exact_top_k, op9_language_id, op10_packing)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    top = """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
              FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
    return {"op8_exact_top_k": top}
