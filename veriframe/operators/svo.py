"""Subject-verb-object relations of chunks, and the edges they give."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.functions import text as T
from veriframe.operators.chunking import exploded


@dataclass(frozen=True)
class RelationRule:
    """A chunk whose lower-cased text has one of ``needles`` states a relation."""

    needles: tuple[str, ...]
    subject_id: str
    relation: str
    object_id: str
    subject_name_type: str = "entity"
    object_name_type: str = "entity"


#: The built-in rules.
RELATION_RULES = (
    RelationRule(("treats", "headache"), "ent_aspirin", "TREATS", "ent_headache"),
    RelationRule(("fever", "reduce"), "ent_aspirin", "REDUCES", "ent_fever"),
)


def extract_relations(chunks: DataFrame, rules: tuple[RelationRule, ...] = RELATION_RULES) -> DataFrame:
    """(chunk_id, subject_id, relation, object_id, ..., source_chunk_ids): every rule that fires on a chunk."""
    lower = F.lower("text")
    hits = [
        F.when(
            T.any_of(lower, r.needles),
            F.struct(*(F.lit(getattr(r, f)).alias(f) for f in ("subject_id", "subject_name_type", "relation", "object_id", "object_name_type"))),
        )
        for r in rules
    ]
    rows = exploded(chunks.select("chunk_id", F.array_compact(F.array(*hits)).alias("hits")), "hits", "r")
    return rows.select("chunk_id", "r.*", F.array("chunk_id").alias("source_chunk_ids"))


def parse_relations(generated: DataFrame, column: str = "generated") -> DataFrame:
    """Relations from a model's comma-separated output; fewer than three parts give none."""
    parts = F.transform(F.split(column, ","), T.strip)
    entity = lambda c: F.concat(F.lit("ent_"), F.regexp_replace(F.lower(c), "[^a-z0-9_]", "_"))
    rows = generated.withColumn("parts", parts).filter(F.size("parts") >= 3)
    return rows.select("chunk_id", entity(F.col("parts")[0]).alias("subject_id"), F.upper(F.col("parts")[1]).alias("relation"), entity(F.col("parts")[2]).alias("object_id"), F.array("chunk_id").alias("source_chunk_ids"))


def entity_edges(relations: DataFrame) -> DataFrame:
    """(subject_id, edge_type, object_id): distinct typed edges; spaces and dashes become underscores, upper case."""
    return relations.select("subject_id", F.upper(F.translate("relation", " -", "__")).alias("edge_type"), "object_id").distinct()


def mentions(relations: DataFrame) -> DataFrame:
    """(chunk_id, entity_id): which chunk mentions which end of its relations."""
    return relations.select("chunk_id", F.explode(F.array("subject_id", "object_id")).alias("entity_id")).distinct()
