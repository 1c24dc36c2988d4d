"""The corpus pipeline: language ID, exact dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and all that the stage before kept; all
but the last return the columns of documents. Edge cases are those of the
operators; a table without documents gives no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftlens.llm import decontaminate, exact_dedup, language_id, near_copies, packing
from driftlens.llm.common import dropped, prepared, table, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus teaches; the others go."""
    prepared(spark)
    return language_id.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original, then the smallest doc_id."""
    prepared(spark)
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Links come from the fingerprints' multi-index tables, verified on sets of five-word shingles at 0.8, and from what
    of such pairs the fingerprints' three bits leave out.
    """
    prepared(spark)
    return near_copies.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    prepared(spark)
    return packing.sequences(docs, packing.default_tokenizer())


STAGES = [("language_id", known_language), ("exact_dedup", exact), ("simhash_dedup", near), ("decontamination", clean), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A recurrent network, fingerprints and a tokenizer are beyond SQL; tests/llm hold each stage against brute force.
ORACLE_SQL = None
