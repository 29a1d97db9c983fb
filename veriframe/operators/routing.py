"""Query routing flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions.text import any_of

#: Substrings that mark a query's type, and the patterns of an exact one.
MULTI_HOP = ("indirectly", "through", "via", "intermediate", "path", "connects")
COMPLEX = ("improves", "relates", "affects", "causes", "impacts", "influences", "correlates", "associated", "similar")
ONTOLOGY = ("violat", "contradict", "inconsistent", "must", "required", "forbidden", "constraint", "rule")
EXACT_PATTERNS = ('".+"', r"\b[A-Z0-9_-]{5,}\b")


def query_types(query: Column) -> Column:
    """Sorted array of complex, exact_match, multi_hop and ontology; a query of no type is complex and exact_match."""
    lower = F.lower(query)
    exact = query.rlike(EXACT_PATTERNS[0]) | query.rlike(EXACT_PATTERNS[1])
    found = F.array_compact(
        F.array(
            F.when(any_of(lower, COMPLEX), "complex"),
            F.when(exact, "exact_match"),
            F.when(any_of(lower, MULTI_HOP), "multi_hop"),
            F.when(any_of(lower, ONTOLOGY), "ontology"),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("complex"), F.lit("exact_match")))


def route(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "query", query_types(F.col("query")).alias("query_types"))


def gated_results(results: DataFrame, routed: DataFrame) -> DataFrame:
    """Optional gating: only results of the retrievers that a query's types call for."""
    wanted = (
        ((F.col("source") == "lexical") & F.array_contains("query_types", "exact_match"))
        | ((F.col("source") == "semantic") & F.array_contains("query_types", "complex"))
        | ((F.col("source") == "graph") & (F.array_contains("query_types", "multi_hop") | F.array_contains("query_types", "ontology")))
    )
    return results.join(routed.select("query_id", "query_types"), "query_id").filter(wanted).drop("query_types")
