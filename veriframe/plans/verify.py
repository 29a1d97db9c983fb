"""Whole query plans: retrieve, verify, adjudicate, validate in batch. Every plan serves one claim or a million alike."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.operators import chunking, concepts, fusion, ontology, retrieval, stance, verdict
from veriframe.operators.joins import broadcast_if_small
from veriframe.operators.text_index import TextIndex
from veriframe.plans.claims import as_queries, with_defaults
from veriframe.sources.shared import cut


class Corpus:
    """Chunks and their concept edges. Both are scanned many times in a plan, so chunks should be a stored table.

    ``index`` may be a stored index of just these chunks; searches then read it and not all chunks.
    """

    def __init__(self, chunks: DataFrame, rules: tuple[concepts.Rule, ...] = concepts.RULES, index: TextIndex | None = None):
        self.chunks, self.rules, self.index = chunks, rules, index

    @cached_property
    def terms(self) -> DataFrame:
        """The chunks' tokens, split once per corpus."""
        return self.index.terms() if self.index else cut(chunking.tokenised(self.chunks))

    @cached_property
    def edges(self) -> DataFrame:
        """Concept edges, derived once per corpus."""
        return cut(concepts.chunk_concepts(concepts.extract_concepts(concepts.possible_chunks(self.chunks, self.rules), self.rules)))


def retrieve(queries: DataFrame, corpus: Corpus, k: int, max_hops: int = 3) -> DataFrame:
    """The three retrievers' results of every query, each cut to its own k best. No table of all pairs is made: a task ranks the pairs of
    its chunks, and passes on k a query."""
    if corpus.index:
        lexical = cut(corpus.index.search(queries, k, "overlap"))
        return retrieval.union_results(lexical, corpus.index.search(queries, k, "jaccard"), retrieval.graph_top_k(queries, corpus.edges, lexical, k, max_hops))
    terms = chunking.tokenised(corpus.chunks)  # read once
    found = retrieval.overlap_searches(queries, terms, k)
    return retrieval.union_results(found["lexical"], found["jaccard"], retrieval.graph_top_k(queries, corpus.edges, found["lexical"], k, max_hops))


def rank(queries: DataFrame, corpus: Corpus, k: int, fallback: bool = True, max_hops: int = 3) -> DataFrame:
    """Fused results of every query; with ``fallback``, queries without a result get the first chunks at score 0."""
    found = retrieve(queries, corpus, k, max_hops)
    if fallback:
        found = cut(found)
        found = found.unionByName(retrieval.fallback_results(queries, found, corpus.chunks, k))
    return fusion.fuse_and_rank(found, k)


def materialise(ranked: DataFrame, chunks: DataFrame, how: str = "inner") -> DataFrame:
    """Ranked results with their texts, and their graph_summary lines if the chunks have such a column: the ranked side is small, so the chunks
    are only scanned."""
    hints = [verdict.graph_lines(F.col("graph_summary"), chunks.schema["graph_summary"].dataType.simpleString()).alias("graph_summary")] if "graph_summary" in chunks.columns else []
    texts = chunks.select("chunk_id", "document_id", "text", *hints)
    return texts.join(broadcast_if_small(cut(ranked)), "chunk_id") if how == "inner" else ranked.join(texts, "chunk_id", how)


def verify(queries: DataFrame, corpus: Corpus, k: int = 10) -> DataFrame:
    """Ranked evidence of free queries."""
    return ontology.gathered_evidence(materialise(rank(queries, corpus, k, fallback=False), corpus.chunks))


def verify_with_ontology(queries: DataFrame, corpus: Corpus, assertions: DataFrame | None, k: int = 10) -> tuple[DataFrame, DataFrame | None]:
    """(status per query, ranked violations) of free queries against ontology assertions."""
    if assertions is None:
        return ontology.ontology_status(queries, None), None
    results = materialise(rank(queries, corpus, k), corpus.chunks)
    found = ontology.ontology_violations(results, with_defaults(assertions))
    return ontology.ontology_status(queries, found), found


def evidence(claims: DataFrame, corpus: Corpus, k: int = 5) -> DataFrame:
    """A row per claim and ranked chunk with the stance of the chunk."""
    texts = materialise(rank(as_queries(claims), corpus, k), corpus.chunks).withColumnRenamed("query_id", "assertion_id")
    return stance.span_stance(stance.match_flags(texts.join(broadcast_if_small(claims), "assertion_id")))


def adjudicate(claims: DataFrame, corpus: Corpus, k: int = 5, judge: Callable[[DataFrame], DataFrame] = verdict.judge) -> DataFrame:
    """Verdicts with all intermediate columns."""
    claims = with_defaults(claims)
    gathered = verdict.collect_evidence(claims, evidence(claims, corpus, k))
    return verdict.merge(judge(verdict.judge_gate(verdict.aggregate(gathered))))


def validate_batch(claims: DataFrame, corpus: Corpus, k: int = 5) -> DataFrame:
    """Final verdicts; ``verdict.summary`` of them is the batch summary."""
    return verdict.final_columns(adjudicate(claims, corpus, k))


def results_as_json(verdicts: DataFrame) -> DataFrame:
    return verdicts.select(F.to_json(F.struct("*")).alias("value"))
