"""Concepts per chunk by needle rules, and their edges."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.functions import text as T
from veriframe.operators.chunking import exploded
from veriframe.operators.components import components
from veriframe.operators.patterns import with_groups
from veriframe.operators.similar import similar_links
from veriframe.sources.shared import cut


#: Needles that are tested one after another; more go into an automaton.
NEEDLES_IN_PLAN = 64


@dataclass(frozen=True)
class Rule:
    """A chunk whose lower-cased text has one of ``needles`` provides and depends on some concepts."""

    needles: tuple[str, ...]
    provides: tuple[str, ...] = ()
    depends_on: tuple[str, ...] = ()
    only_without_others: bool = False


#: The built-in rules.
RULES = (
    Rule(("controller type", "above the worker type"), provides=("hierarchy",)),
    Rule(("resolution pathway", "determined by its manager"), provides=("resolution pathway",), depends_on=("hierarchy",)),
    Rule(("hierarchy",), provides=("hierarchy",), only_without_others=True),
)


def extract_concepts(chunks: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``chunks`` with provides and depends_on, distinct and in order of the rules.

    Up to NEEDLES_IN_PLAN needles are tests of the plan; more are one automaton, which reads a text once, however many they are.
    """
    plain, last = [r for r in rules if not r.only_without_others], [r for r in rules if r.only_without_others]
    if sum(len(r.needles) for r in rules) > NEEDLES_IN_PLAN:
        return _extracted(chunks, plain, last)
    lower, own = "lower", "own"
    while {lower, own} & set(chunks.columns):
        lower, own = lower + "_", own + "_"

    def found(field: str, chosen: list[Rule]) -> Column:
        parts = [F.when(T.any_of(F.col(lower), r.needles), F.lit(list(getattr(r, field)))).otherwise(F.array().cast("array<string>")) for r in chosen if getattr(r, field)]
        return F.array_distinct(F.concat(*parts)) if parts else F.array().cast("array<string>")

    # columns of their own, as the planner would lower a text anew for every needle
    rows = chunks.withColumn(lower, F.lower("text")).withColumn(own, found("provides", plain))
    provides = F.when(F.size(own) > 0, F.col(own)).otherwise(found("provides", last))
    return rows.withColumns({"provides": provides, "depends_on": found("depends_on", plain)}).drop(lower, own)


def possible_chunks(chunks: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``chunks`` without those that no rule meets, which have no edges; all of them if the needles are too many for a plan."""
    needles = [n for r in rules for n in r.needles]
    # once, as the planner would lower a text anew for every needle
    return chunks if len(needles) > NEEDLES_IN_PLAN else chunks.filter(T.once(F.lower("text"), lambda t: T.any_of(t, needles)))


def _extracted(chunks: DataFrame, plain: list[Rule], last: list[Rule]) -> DataFrame:
    """The same by the numbers of the rules that a text meets, plain ones first."""
    hits = "hits"
    while hits in chunks.columns:
        hits += "_"
    rows = with_groups(chunks, F.lower("text"), [r.needles for r in (*plain, *last)], hits)

    def found(field: str, which: Column) -> Column:
        named = F.from_json(F.lit(json.dumps([list(getattr(r, field)) for r in (*plain, *last)])), "array<array<string>>")
        return F.array_distinct(F.flatten(F.transform(which, lambda k: F.element_at(named, k + 1))))

    own, others = F.filter(hits, lambda k: k < len(plain)), F.filter(hits, lambda k: k >= len(plain))
    provides = found("provides", own)
    return rows.withColumns({"provides": F.when(F.size(provides) > 0, provides).otherwise(found("provides", others)), "depends_on": found("depends_on", own)}).drop(hits)


def chunk_concepts(described: DataFrame) -> DataFrame:
    """(chunk_id, concept, edge_type): distinct edges; missing arrays count as empty, names are trimmed and lower-cased."""
    empty = F.array().cast("array<string>")

    def side(column: str, kind: str) -> Column:
        return F.transform(F.coalesce(column, empty), lambda c: F.struct(F.lower(T.strip(c)).alias("concept"), F.lit(kind).alias("edge_type")))

    edges = F.array_distinct(F.concat(side("provides", "PROVIDES"), side("depends_on", "DEPENDS_ON")))
    return exploded(described.select("chunk_id", edges.alias("edges")), "edges", "e").select("chunk_id", "e.concept", "e.edge_type")


def canonical_concepts(terms: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(term, canonical): terms whose vectors' cosine exceeds ``threshold`` are joined, transitively; the shortest term, stripped and
    lower-cased, names the cluster. Input (term, embedding); of repeated terms one counts.

    Likenesses come from ``similar.similar_links``, clusters are connected components of these.
    """
    vocabulary = cut(terms.select("term", "embedding").filter("term IS NOT NULL").dropDuplicates(["term"]))
    roots = components(similar_links(vocabulary, threshold)).withColumnRenamed("node", "term")
    clusters = cut(vocabulary.select("term").join(roots, "term", "left").select("term", F.coalesce("root", "term").alias("root")))
    names = clusters.groupBy("root").agg(F.min(F.struct(F.length("term").alias("n"), "term")).alias("best"))
    return clusters.join(names, "root").select("term", F.lower(T.strip(F.col("best.term"))).alias("canonical"))


def default_rules(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rules as a table (needle, concept, edge_type), to look at or store."""
    rows = [(n, c, kind) for r in rules for n in r.needles for kind, cs in (("PROVIDES", r.provides), ("DEPENDS_ON", r.depends_on)) for c in cs]
    return spark.createDataFrame(rows, "needle string, concept string, edge_type string")
