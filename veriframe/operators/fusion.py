"""Weighted fusion of retrieval results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions import text as T

WEIGHTS = {"lexical": 0.3, "semantic": 0.5, "graph": 0.2}
BOOST = 0.1


def fuse(results: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score, sources, n_sources, first_seen): one row per query and chunk.

    The best score of each source counts; other sources count in the lexical slot under their own name. Lexical scores are
    scaled to their range within the query, the others clipped to 0..1; each source beyond the first adds a boost.
    """
    slot = F.when(F.col("source").isin("semantic", "graph"), F.col("source")).otherwise("lexical")
    best = {s: F.coalesce(F.max(F.when(slot == s, F.greatest(F.col("score"), F.lit(0.0)))), F.lit(0.0)).alias(s) for s in WEIGHTS}
    grouped = results.groupBy("query_id", "chunk_id").agg(*best.values(), F.array_sort(F.collect_set("source")).alias("sources"), F.min(F.struct("src_ord", "rank")).alias("first_seen"))
    own = Window.partitionBy("query_id")
    positive = F.when(F.col("lexical") > 0, F.col("lexical"))
    low, high = F.min(positive).over(own), F.max(positive).over(own)
    lexical = F.when(F.col("lexical") <= 0, 0.0).when(high == low, 1.0).otherwise((F.col("lexical") - low) / (high - low))
    total = WEIGHTS["lexical"] * lexical + WEIGHTS["semantic"] * T.clip01(F.col("semantic")) + WEIGHTS["graph"] * T.clip01(F.col("graph")) + BOOST * (F.size("sources") - 1)
    return grouped.select("query_id", "chunk_id", total.alias("score"), "sources", F.size("sources").alias("n_sources"), "first_seen")


def fuse_and_rank(results: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, source, contributing_sources, rank): the k best; ties keep the order in which they were first seen."""
    order = Window.partitionBy("query_id").orderBy(T.rank_key(F.col("score")).desc(), "first_seen")
    ranked = fuse(results).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "chunk_id", "score", F.lit("fusion").alias("source"), F.col("sources").alias("contributing_sources"), "rank")
