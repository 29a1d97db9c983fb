"""Ontology violations and plain evidence listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions import text as T
from veriframe.operators.joins import broadcast_if_small
from veriframe.operators.patterns import contained
from veriframe.operators.stance import match_flags
from veriframe.sources.shared import cut

VIOLATIONS = ("contradiction", "partial_match", "candidate_violation")
#: Confidence and wording of each finding.
FINDINGS = {
    "contradiction": (0.94, "Matched assertion but found explicit negation or forbidden polarity."),
    "satisfied": (0.9, "Matched assertion text directly."),
    "partial_match": (0.65, "Subject and relation matched but object was missing."),
    "candidate_violation": (0.5, "Only a partial ontology match was found."),
    "unmatched": (0.2, "No direct assertion match found in the chunk."),
}


def score_violations(flagged: DataFrame) -> DataFrame:
    """Adds violation_type, confidence and evidence; here the polarity "forbidden" counts like must_not_hold."""
    s, r, o = F.col("matched_subject"), F.col("matched_relation"), F.col("matched_object")
    against = F.col("negated") | F.col("polarity").isin("forbidden", "must_not_hold")

    def choose(*values) -> Column:
        return F.when(s & r & o & against, values[0]).when(s & r & o, values[1]).when(s & r, values[2]).when(s | o, values[3]).otherwise(values[4])

    return flagged.withColumns(
        {
            "violation_type": choose(*FINDINGS),
            "confidence": choose(*(c for c, _ in FINDINGS.values())),
            "evidence": choose(*(t for _, t in FINDINGS.values())),
        }
    )


def matched_pairs(results: DataFrame, assertions: DataFrame) -> DataFrame:
    """Ranked chunks beside each assertion whose subject or object they hold; no finding is listed of any other pair.

    One automaton over the assertions' parts runs once over each distinct chunk, and equalities of parts lead back to the assertions.
    """
    listed = cut(assertions.select("assertion_id", "subject", "relation", "object", "polarity").withColumn("nth", F.monotonically_increasing_id()))
    parts = cut(listed.select("nth", F.explode(F.array_distinct(F.array(T.normalise(F.col("subject")), T.normalise(F.col("object"))))).alias("pattern")).filter("pattern <> ''"))
    rows = cut(results.filter(F.col("text").isNotNull()).select("query_id", "chunk_id", F.col("rank").alias("result_rank"), "text"))
    texts = rows.select(F.struct("chunk_id", F.xxhash64("text").alias("h")).alias("id"), T.normalise(F.col("text")).alias("text")).dropDuplicates(["id"])
    met = contained(texts, parts).join(broadcast_if_small(parts), "pattern").select("id", "nth").distinct()
    found = rows.withColumn("id", F.struct("chunk_id", F.xxhash64("text").alias("h"))).join(met, "id").drop("id")
    return found.join(broadcast_if_small(listed), "nth").drop("nth")


def ontology_violations(results: DataFrame, assertions: DataFrame) -> DataFrame:
    """Ranked violations per query: the ranked chunks (query_id, chunk_id, rank, text) against all assertions.

    Ranked by confidence, then result rank, then assertion_id.
    """
    found = score_violations(match_flags(matched_pairs(results, assertions))).filter(F.col("violation_type").isin(*VIOLATIONS))
    order = Window.partitionBy("query_id").orderBy(F.desc("confidence"), "result_rank", "assertion_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "assertion_id", "chunk_id", "violation_type", "confidence", F.lit("validator").alias("source"), "evidence", "text")


def ontology_status(queries: DataFrame, violations: DataFrame | None) -> DataFrame:
    """(query_id, status): skipped without assertions (None), otherwise validated if there are violations and OK if not."""
    if violations is None:
        return queries.select("query_id", F.lit("ONTOLOGY_VALIDATION_SKIPPED").alias("status"))
    bad = violations.groupBy("query_id").agg(F.count("*").alias("violations"))
    status = F.when(F.col("violations") > 0, "ONTOLOGY_VALIDATED").otherwise("ONTOLOGY_VALIDATION_OK")
    return queries.select("query_id").join(bad, "query_id", "left").select("query_id", status.alias("status"))


def gathered_evidence(results: DataFrame) -> DataFrame:
    """(query_id, rank, chunk_id, score, retrieval_source, text, status): the plain listing; text may be null."""
    return results.select("query_id", "rank", "chunk_id", F.round("score", 4).alias("score"), F.col("source").alias("retrieval_source"), "text", F.lit("EVIDENCE_GATHERED").alias("status"))


def validated_evidence(results: DataFrame) -> DataFrame:
    """The listing with a model's columns label and confidence; blank text is neutral at 0."""
    blank = F.coalesce(F.trim("text") == "", F.lit(True))
    rows = results.withColumns({"label": F.when(blank, "neutral").otherwise(F.col("label")), "confidence": F.when(blank, 0.0).otherwise(F.round("confidence", 4))})
    return rows.select("query_id", "rank", "chunk_id", F.round("score", 4).alias("score"), F.col("source").alias("retrieval_source"), "text", "label", "confidence", F.lit("EVIDENCE_VALIDATED").alias("status"))
