"""The corpus pipeline: five stages over ``documents``, each on all that the one before it kept.

Every stage takes null and empty texts, texts of any length, repeated rows, rows without an id, empty tables and further
columns of any name; all but the last return the columns of their input.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessella.llm import ngram_join, packing, pii, substring_dedup, toxicity
from tessella.llm.common import Stash, load

#: Shingles of five words and a similarity of 0.8; windows of 20 words; sequences of 4096 ids.
SHINGLE, PERCENT, WINDOW, TOXIC = 5, 80, 20, 0.7


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labelled documents, rejects go; null and empty texts have no hits and stay, equal texts share their fate."""
    lexicon = toxicity.learn(spark, load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(spark, docs, lexicon, TOXIC)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id.

    Null and empty texts are groups of their own and stay; of rows that repeat a doc_id one stays, rows without an id all do.
    """
    return ngram_join.drop_similar(spark, docs, SHINGLE, PERCENT)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of passages that repeat, the first occurrence stays; texts without repeats, null ones too, stay as they are. Rows without an id lose nothing."""
    return substring_dedup.cut_documents(spark, docs, WINDOW)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced with marks; null texts stay null, each row is read for itself."""
    return pii.redact(spark, docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids; a null or empty text is its end id alone, each row a document of its own. No documents give no pieces."""
    return packing.pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Learned weights, components and packing are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences. Each stage's output is written and read again; it goes when the next one is written, the last with the session's folder."""
    docs, held = load(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        new = Stash(spark, stage(spark, docs, sf_dir))
        if held:
            held.drop()
        docs, held = new.df, new
    return STAGES[-1][1](spark, docs, sf_dir)
