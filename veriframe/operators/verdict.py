"""From evidence to verdicts: aggregation, judging, merging, summaries. One grouped aggregation per step for all claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions import text as T

CLAIM = ("assertion_id", "subject", "relation", "object", "polarity", "rule_type")
LABELS = ("supported", "contradicted", "partial", "unknown")

#: What verdicts and judgements say; {} is a chunk's id.
NO_EVIDENCE = "No evidence was retrieved for this triple."
RATIONALES = {
    "supported": "The triple is supported by chunk {} with direct subject, relation, and object matches.",
    "contradicted": "The triple is contradicted by chunk {}, which contains the assertion with explicit negation or forbidden polarity.",
    "partial": "The retrieved chunks partially match the triple, but one or more components are missing or incomplete.",
    "unknown": "The retrieved evidence is insufficient to determine whether the triple is correct.",
}
JUDGEMENTS = {
    "contradicted": (0.8, "Evidence contains explicit refutation of the assertion."),
    "supported": (0.88, "Evidence contains a direct support match for the assertion."),
    "partial": (0.55, "Evidence partially matches the assertion but is not conclusive."),
    "unknown": (0.2, "The evidence is insufficient to determine the assertion."),
}
#: The least score of a label.
FLOORS = {"supported": 0.8, "contradicted": 0.75, "partial": 0.35}


def collect_evidence(claims: DataFrame, stances: DataFrame) -> DataFrame:
    """A row per claim with its evidence, an array of at most k entries in rank order, and the graph_summary lines of its chunks; claims
    without any have empty arrays."""
    entry = F.struct("rank", "chunk_id", "text", "support_type", "confidence", F.col("score").alias("retrieval_score"), "contributing_sources", "matched_subject", "matched_relation", "matched_object")
    lines = F.col("graph_summary") if "graph_summary" in stances.columns else F.array().cast("array<string>")
    hints = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", lines.alias("lines"))))
    grouped = stances.groupBy("assertion_id").agg(F.array_sort(F.collect_list(entry)).alias("evidence"), F.flatten(F.transform(hints, lambda h: h["lines"])).alias("graph_summary"))
    empty = {c: F.coalesce(c, F.array().cast(grouped.schema[c].dataType)) for c in ("evidence", "graph_summary")}
    return claims.join(grouped, "assertion_id", "left").withColumns(empty)


def _of(kind: str) -> Column:
    return F.filter("evidence", lambda e: e["support_type"] == kind)


def _total(entries: Column, field: str) -> Column:
    return F.aggregate(entries, F.lit(0.0), lambda s, e: s + e[field])


def aggregate(gathered: DataFrame) -> DataFrame:
    """Adds the heuristic verdict: label, score, rationale, rule_hits, retrieval_sources, counter_evidence and strengths."""
    rows = gathered.withColumns(
        {
            "supports": _of("supports"),
            "refutes": _of("refutes"),
            "partials": _of("partial"),
            "unknowns": _of("unknown"),
            "retrieval_sources": F.array_sort(F.array_distinct(F.flatten(F.transform("evidence", lambda e: e["contributing_sources"])))),
        }
    )
    rows = rows.withColumns({f"{n}_strength": _total(F.col(f"{n}s"), "confidence") for n in ("support", "refute", "partial")})
    s, r, p = (F.col(f"{n}_strength") for n in ("support", "refute", "partial"))
    none = F.size("evidence") == 0
    bonus = 0.08 * F.greatest(F.lit(0), F.size("retrieval_sources") - 1)
    raw = F.round(T.clip01(0.2 + 0.6 * s + 0.15 * p + bonus - 0.55 * r), 4)
    label = F.when((r > s) & (r >= 0.6), "contradicted").when((s >= 0.7) & (r == 0), "supported").when((s > 0) | (p > 0), "partial").otherwise("unknown")
    rows = rows.withColumns({"label": F.when(none, "unknown").otherwise(label), "raw": raw})
    floor = F.coalesce(*(F.when(F.col("label") == x, f) for x, f in FLOORS.items()), F.lit(0.0))
    hits = F.array_compact(
        F.array(
            F.when(F.size("supports") > 0, "direct_support"),
            F.when(F.size("refutes") > 0, "explicit_negation"),
            F.when(F.size("partials") > 0, "partial_match"),
            F.when((F.size("unknowns") > 0) & (F.size("unknowns") == F.size("evidence")), "insufficient_evidence"),
        )
    )
    cited = {"supported": F.get("supports", 0)["chunk_id"], "contradicted": F.get("refutes", 0)["chunk_id"]}
    said = [F.when(F.col("label") == x, F.replace(F.lit(t), F.lit("{}"), cited[x]) if x in cited else F.lit(t)) for x, t in RATIONALES.items()]
    rationale = F.when(none, NO_EVIDENCE).otherwise(F.coalesce(*said))
    return rows.withColumns(
        {
            "score": F.when(none, 0.1).otherwise(F.greatest(F.col("raw"), floor)),
            "rule_hits": F.when(none, F.array(F.lit("no_evidence"))).otherwise(hits),
            "rationale": rationale,
            "counter_evidence": F.col("refutes"),
        }
    ).drop("raw")


def graph_lines(hint: Column, kind: str) -> Column:
    """A chunk's graph summary as an array of non-blank lines, from a string or an array of them; ``kind`` is the column's type."""
    listed = hint if kind.startswith("array") else F.array(F.trim(hint))
    return F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))


def judge_gate(verdicts: DataFrame) -> DataFrame:
    """Adds needs_judge: whether a verdict is worth a judge's second look; a graph line that names an edge is a reason."""
    edge = lambda x: F.contains(x, F.lit("->")) | F.contains(x, F.lit("DEPENDS_ON")) | F.contains(x, F.lit("PROVIDES"))
    told = F.exists("graph_summary", edge) if "graph_summary" in verdicts.columns else F.lit(False)
    mixed = (F.size("supports") > 0) & (F.size("refutes") > 0)
    return verdicts.withColumn("needs_judge", F.col("label").isin("partial", "unknown") | mixed | (F.size("retrieval_sources") > 1) | told | (F.col("score") < 0.6))


def judge(gated: DataFrame) -> DataFrame:
    """Adds judge_label, judge_confidence, judge_rationale and the ids that the heuristic judge names, where needs_judge."""
    s, r, p = F.col("supports"), F.col("refutes"), F.col("partials")
    refuted = (F.size(r) > 0) & (F.size(r) >= F.size(s)) & (_total(r, "retrieval_score") >= 0.6)
    direct = (F.size(s) > 0) & (F.size(r) == 0) & F.exists(s, lambda e: e["matched_subject"] & e["matched_relation"] & e["matched_object"])
    some = (F.size(s) > 0) | (F.size(p) > 0)
    ids = lambda c: F.transform(c, lambda e: e["chunk_id"])
    none = F.array().cast("array<string>")
    asked = F.col("needs_judge")

    def choose(contradicted, supported, partial, unknown) -> Column:
        return F.when(asked, F.when(refuted, contradicted).when(direct, supported).when(some, partial).otherwise(unknown))

    order = ("contradicted", "supported", "partial", "unknown")
    return gated.withColumns(
        {
            "judge_label": choose(*order),
            "judge_confidence": choose(*(JUDGEMENTS[x][0] for x in order)),
            "judge_rationale": choose(*(JUDGEMENTS[x][1] for x in order)),
            "judge_evidence_ids": choose(ids(s), ids(s), ids(F.when(F.size(s) > 0, s).otherwise(p)), none),
            "judge_counter_ids": choose(ids(r), none, ids(r), ids(r)),
        }
    )


#: How a generating judge's answer is read, by substring and in this order.
LABEL_ALIASES = (
    ("support", "supported"),
    ("entail", "supported"),
    ("true", "supported"),
    ("contradict", "contradicted"),
    ("refute", "contradicted"),
    ("false", "contradicted"),
    ("partially", "partial"),
    ("mixed", "partial"),
    ("insufficient", "unknown"),
    ("not enough", "unknown"),
    ("no evidence", "unknown"),
    ("cannot determine", "unknown"),
    ("unclear", "unknown"),
    ("neutral", "unknown"),
)


def parse_judge_label(answer: Column, aliases: tuple[tuple[str, str], ...] = LABEL_ALIASES) -> Column:
    """A label from generated text: the first label that it contains, else that of the first alias; null if there is none."""
    lower = F.lower(F.trim(answer))
    found = F.coalesce(*(F.when(F.contains(lower, F.lit(x)), F.lit(x)) for x in LABELS))
    return F.coalesce(found, *(F.when(F.contains(lower, F.lit(a)), F.lit(x)) for a, x in aliases))


def sequence_confidence(probabilities: Column) -> Column:
    """Geometric mean of token probabilities within 0.3..1; 0.6 if there are none."""
    logs = F.transform(probabilities, lambda p: F.log(F.greatest(p, F.lit(1e-9))))
    mean = F.exp(F.try_divide(F.aggregate(logs, F.lit(0.0), lambda s, x: s + x), F.size(probabilities)))
    return F.when(F.size(probabilities) > 0, F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.3), mean)), 4)).otherwise(F.lit(0.6))


def merge(judged: DataFrame) -> DataFrame:
    """The final verdict: the judge's label, a score that both allow, both rationales, and sorted rule hits."""
    h, j = F.col("label"), F.col("judge_label")
    agree = (h == j) | ((j == "supported") & (h != "contradicted")) | ((j == "contradicted") & (h != "supported"))
    asked = j.isNotNull()
    score = F.when(agree, F.greatest("score", "judge_confidence")).otherwise(F.col("score"))
    extra = F.when(asked, F.array(F.lit("lm_judge"), F.lit("heuristic_baseline"), F.lit("evidence_judge"))).otherwise(F.array(F.lit("heuristic_baseline"), F.lit("evidence_judge")))
    return judged.withColumns(
        {
            "final_label": F.coalesce(j, h),
            "final_score": F.when(asked, F.round(T.clip01(score), 4)).otherwise(F.col("score")),
            "final_rationale": F.when(asked, F.concat(F.lit("Heuristic: "), F.col("rationale"), F.lit(" LM: "), F.col("judge_rationale"))).otherwise(F.col("rationale")),
            "final_rule_hits": F.array_sort(F.array_distinct(F.concat("rule_hits", extra))),
        }
    )


def final_columns(merged: DataFrame) -> DataFrame:
    """The verdict as callers get it."""
    return merged.select(
        "assertion_id", "subject", "relation", "object",
        F.col("final_label").alias("label"), F.col("final_score").alias("score"), F.col("final_rationale").alias("rationale"),
        "evidence", "counter_evidence", "retrieval_sources", F.col("final_rule_hits").alias("rule_hits"),
    )


def summary(verdicts: DataFrame) -> DataFrame:
    """One row: total_triples, a count per label, avg_score (0 if there is none)."""
    counts = [F.count_if(F.col("label") == x).alias(x) for x in LABELS]
    return verdicts.agg(F.count("*").alias("total_triples"), *counts, F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 4).alias("avg_score"))


def score_bucket(score: Column) -> Column:
    return F.when(score >= 0.9, "very_high").when(score >= 0.75, "high").when(score >= 0.5, "medium").when(score >= 0.25, "low").otherwise("very_low")
