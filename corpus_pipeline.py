"""The corpus pipeline: documents with a language, without exact and near copies, without secrets, packed into sequences.

Every stage takes the rows that the one before kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veriframe.llm import exact_dedup, language_id, packing, secret_scan, simhash
from veriframe.llm.common import cut, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which language identification finds a language, which is filled in where there is no label; those without a letter go."""
    return language_id.keep_identified(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without their white space."""
    return exact_dedup.keep_first(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of near fingerprints."""
    return simhash.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a marker, and n_chars counted again where that changed a text."""
    return secret_scan.redact(docs, count_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: one row per piece of a document."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identified),
    ("exact_dedup", distinct),
    ("simhash_near_dedup", unlike),
    ("secret_scan", without_secrets),
    ("best_fit_packing", packed),
]

#: Models, tokenizers and components cannot be expressed in SQL; a test compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
