"""Concept search with scores: full-text seeds, the best path to every chunk, and the chain that it takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions import text as T
from veriframe.operators.chunking import exploded
from veriframe.operators.joins import broadcast_if_small
from veriframe.operators.retrieval import DECAY, top_k
from veriframe.operators.text_index import _saturated
from veriframe.sources.shared import cut


def concept_index(edges: DataFrame) -> DataFrame:
    """(concept, all): the distinct concepts of edges as a full-text index of their names has them."""
    return edges.select("concept").distinct().select("concept", T.all_tokens(F.col("concept")).alias("all"))


def scored_seeds(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, concept, score): the concepts that share a token with a query, scored by BM25 over the concepts' names.

    Queries and names meet in an equality of tokens. The vocabulary of concepts is scanned, not the chunks.
    """
    index = cut(concept_index(edges))
    totals = index.agg(F.count("*").alias("n"), F.avg(F.size("all")).alias("mean")).first()
    terms = exploded(index.select("concept", "all", F.array_distinct("all").alias("tokens")), "tokens", "token")
    terms = cut(terms.select("concept", "token", F.size("all").alias("size"), F.size(F.filter("all", lambda x: x == F.col("token"))).alias("tf")))
    df = F.col("df")
    weights = terms.groupBy("token").agg(F.count("*").alias("df")).select("token", F.log(1 + (totals["n"] - df + 0.5) / (df + 0.5)).alias("weight"))
    asked = exploded(queries.select("query_id", T.tokens(F.col("query")).alias("tokens")), "tokens", "token")
    met = asked.join(broadcast_if_small(terms.join(weights, "token")), "token")
    return met.groupBy("query_id", "concept").agg(F.sum(F.col("weight") * _saturated(F.col("tf"), F.col("size"), totals["mean"] or 1.0)).alias("score"))


def beside(edges: DataFrame) -> DataFrame:
    """(concept, beside, via): concepts that share a chunk, with the greatest id of such a chunk.

    A pair is one row, however many chunks it shares: a concept of very many chunks costs a search no more than its neighbours' number.
    """
    a, b = edges.select("chunk_id", "concept").distinct(), edges.select("chunk_id", F.col("concept").alias("beside")).distinct()
    return a.join(b, "chunk_id").filter("concept <> beside").groupBy("concept", "beside").agg(F.max("chunk_id").alias("via"))


def best_paths(queries: DataFrame, edges: DataFrame, max_hops: int = 3, decay: float = DECAY) -> DataFrame:
    """(query_id, concept, score, length, path): the best path from a query's seeds to every concept in reach.

    A path goes concept, chunk, concept, ...; each edge but the first of those that lead on to a chunk costs a factor ``decay``, so a further concept costs
    two. Of equally good paths the shorter, then the one first in order stays, with all its steps.
    """
    near = cut(beside(edges))
    start = scored_seeds(queries, edges).select("query_id", "concept", "score", F.lit(1).alias("length"), F.array("concept").alias("path"))
    reached = front = cut(start)
    for _ in range((max_hops - 1) // 2):
        step = front.join(near, "concept").select("query_id", F.col("beside").alias("concept"), (F.col("score") * decay * decay).alias("score"), (F.col("length") + 2).alias("length"), F.concat("path", F.array("via", "beside")).alias("path"))
        front = cut(_best(step))
        reached = cut(_best(reached.unionByName(front)))
    return reached


def _best(rows: DataFrame) -> DataFrame:
    worst = F.struct(-T.rank_key(F.col("score")), "length", "path")
    return rows.groupBy("query_id", "concept").agg(F.min_by(F.struct("score", "length", "path"), worst).alias("b")).select("query_id", "concept", "b.*")


def evidence_paths(queries: DataFrame, edges: DataFrame, k: int, max_hops: int = 3, decay: float = DECAY) -> DataFrame:
    """(query_id, chunk_id, score, rank, length, path): the ``k`` chunks of the best paths, with the chain from a seed concept to the chunk.

    length counts edges and is odd, as every second node is a chunk. All chunks of a concept score alike, so of each concept only the ``k``
    greatest ids can be needed.
    """
    order = Window.partitionBy("concept").orderBy(F.desc("chunk_id"))
    last = edges.select("concept", "chunk_id").distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).drop("n")
    hits = best_paths(queries, edges, max_hops, decay).join(last, "concept").withColumn("path", F.concat("path", F.array("chunk_id")))
    worst = F.struct(-T.rank_key(F.col("score")), "length", "path")
    one = hits.groupBy("query_id", "chunk_id").agg(F.min_by(F.struct("score", "length", "path"), worst).alias("b")).select("query_id", "chunk_id", "b.*")
    return top_k(one, k)


def scored_graph_top_k(queries: DataFrame, edges: DataFrame, k: int, max_hops: int = 3, decay: float = DECAY) -> DataFrame:
    """(query_id, chunk_id, score, rank): concept search whose seeds carry their full-text score along the path; of several paths to a chunk the best counts."""
    return evidence_paths(queries, edges, k, max_hops, decay).select("query_id", "chunk_id", "score", "rank")
