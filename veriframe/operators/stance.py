"""What a chunk says about a claim: flags, stances, and model-backed variants that map probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions import text as T


#: Confidence and wording of the labels of a chunk alone.
TRIPLE_LABELS = {
    "supported": (0.94, "Direct match for subject, relation, and object."),
    "contradicted": (0.9, "Direct triple match appears with explicit negation."),
    "partial": (0.62, "Only part of the triple is present in the chunk."),
    "unknown": (0.18, "No meaningful triple match was found."),
}


def match_flags(pairs: DataFrame, text_col: str = "text") -> DataFrame:
    """``pairs`` of claim and chunk with matched_subject, matched_relation, matched_object, negated and negated_triple."""
    rows = pairs.withColumn("normal", T.normalise(F.coalesce(F.col(text_col), F.lit(""))))
    normal = F.col("normal")
    return rows.withColumns(
        {
            "matched_subject": T.holds(normal, F.col("subject")),
            "matched_relation": T.holds(normal, F.col("relation")),
            "matched_object": T.holds(normal, F.col("object")),
            "negated": T.any_of(normal, T.NEGATIONS),
            "negated_triple": T.any_of(normal, T.TRIPLE_NEGATIONS),
        }
    ).drop("normal")


def _parts() -> tuple[Column, Column, Column]:
    return F.col("matched_subject"), F.col("matched_relation"), F.col("matched_object")


def _confidence(own: Column, score: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(own, score)), 4)


def span_stance(flagged: DataFrame) -> DataFrame:
    """Adds support_type and confidence; the retrieval score (column score) raises the confidence."""
    s, r, o = _parts()
    against = F.col("negated") | (F.col("polarity") == "must_not_hold")
    kind = F.when(s & r & o, F.when(against, "refutes").otherwise("supports")).when((s & r) | s | o, "partial").otherwise("unknown")
    own = F.when(s & r & o, F.when(against, 0.9).otherwise(0.95)).when(s & r, 0.7).when(s | o, 0.5).otherwise(0.2)
    return flagged.withColumns({"support_type": kind, "confidence": _confidence(own, F.col("score"))})


def span_stance_from_probabilities(flagged: DataFrame) -> DataFrame:
    """The same from a model's columns entailment, neutral and contradiction; where they are null, the heuristic decides.

    The top label counts; polarity must_not_hold flips entailment and contradiction; neutral is unknown from 0.6 on, else partial.
    """
    e, n, c = F.col("entailment"), F.col("neutral"), F.col("contradiction")
    top = F.greatest(e, n, c)
    flip = F.col("polarity") == "must_not_hold"
    kind = F.when(e == top, F.when(flip, "refutes").otherwise("supports")).when(c == top, F.when(flip, "supports").otherwise("refutes")).when(n >= 0.6, "unknown").otherwise("partial")
    known = top.isNotNull()
    base = span_stance(flagged)
    return base.withColumns({"support_type": F.when(known, kind).otherwise(F.col("support_type")), "confidence": F.when(known, _confidence(top, F.col("score"))).otherwise(F.col("confidence"))})


def classify_triples(flagged: DataFrame) -> DataFrame:
    """Adds label, confidence and rationale for a chunk alone; polarity isn't considered."""
    s, r, o = _parts()
    no = F.col("negated_triple")
    full, part = s & r & o, s & (r | o)

    def choose(supported, contradicted, partial, unknown) -> Column:
        return F.when(full & ~no, supported).when(full, contradicted).when(part, partial).otherwise(unknown)

    label = choose(*TRIPLE_LABELS)
    confidence, rationale = (choose(*(v[k] for v in TRIPLE_LABELS.values())) for k in range(2))
    return flagged.withColumns({"label": label, "confidence": confidence, "rationale": rationale})


def triple_label_from_zero_shot(answer: Column) -> Column:
    """A zero-shot classifier's answer as a label."""
    return F.when(answer == "supports", "supported").when(answer == "refutes", "contradicted").otherwise("unknown")
