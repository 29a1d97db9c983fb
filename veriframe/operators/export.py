"""Training examples from verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.operators.verdict import score_bucket


def training_examples(verdicts: DataFrame, document_id: str = "unknown_document", carry_polarity: bool = False) -> DataFrame:
    """One example per verdict, from its first evidence chunk. ``carry_polarity`` takes the claim's own polarity and rule type."""
    top = F.get("evidence", 0)
    chunk = F.coalesce(top["chunk_id"], F.lit("unknown_chunk"))
    polarity, rule = (F.col("polarity"), F.col("rule_type")) if carry_polarity else (F.lit("must_hold"), F.lit("constraint"))
    claim = F.struct("assertion_id", "subject", "relation", "object", polarity.alias("polarity"), rule.alias("rule_type"))
    return verdicts.select(
        F.concat(F.lit("ex_"), F.col("assertion_id"), F.lit("_"), chunk).alias("example_id"),
        F.lit("triple_classification").alias("task"),
        F.lit(document_id).alias("document_id"),
        chunk.alias("chunk_id"),
        F.struct(F.coalesce(top["text"], F.lit("")).alias("chunk_text"), claim.alias("assertion")).alias("input"),
        F.struct("label", score_bucket(F.col("score")).alias("score_bucket"), "rationale", "retrieval_sources", "rule_hits").alias("output"),
    )


def explicit_examples(rows: DataFrame) -> DataFrame:
    """Examples from given columns: example_id, document_id, chunk_id, chunk_text, the claim, label, score, rationale."""
    claim = F.struct("assertion_id", "subject", "relation", "object", "polarity", "rule_type")
    return rows.select(
        "example_id",
        F.lit("triple_classification").alias("task"),
        "document_id",
        "chunk_id",
        F.struct("chunk_text", claim.alias("assertion")).alias("input"),
        F.struct("label", score_bucket(F.col("score")).alias("score_bucket"), "rationale").alias("output"),
    )


def as_json_lines(examples: DataFrame) -> DataFrame:
    """One JSON object per row, keys in column order."""
    return examples.select(F.to_json(F.struct("example_id", "task", "document_id", "chunk_id", "input", "output")).alias("value"))
