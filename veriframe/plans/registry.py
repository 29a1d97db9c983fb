"""Registry of the claim-verification queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.functions import text as T
from veriframe.operators import chunking, export, fusion, fuzzy, ontology, paths, retrieval, routing, stance, svo, verdict
from veriframe.operators.concepts import canonical_concepts, chunk_concepts, extract_concepts
from veriframe.operators.text_index import TextIndex
from veriframe.plans import oracle, verify
from veriframe.plans.claims import as_queries, claims
from veriframe.operators.vector_index import VectorIndex, recall
from veriframe.plans.oracle import ALIKE, DATA_RELATIONS, DATA_RULES, K, PHRASE_RULES
from veriframe.sources.shared import cut, new_folder


class Inputs:
    """The driver's tables as the plans' inputs. Chunks and claims are stored when a plan first asks for them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.documents, self.benchmark = self.read("documents"), self.read("benchmark")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def fresh_chunks(self) -> DataFrame:
        return chunking.chunk_documents(self.documents, "doc_id", "text")

    @cached_property
    def chunks(self) -> DataFrame:
        return cut(self.fresh_chunks.drop("word_count"))

    @cached_property
    def corpus(self) -> verify.Corpus:
        return verify.Corpus(self.chunks, DATA_RULES)

    @cached_property
    def claims(self) -> DataFrame:
        return cut(claims(self.spark, self.documents, self.chunks, self.benchmark))

    @cached_property
    def queries(self) -> DataFrame:
        return as_queries(self.claims)

    @property
    def terms(self) -> DataFrame:
        return self.corpus.terms

    @property
    def terms_once(self) -> DataFrame:
        """The same for plans that read them once."""
        return chunking.tokenised(self.chunks)

    @cached_property
    def found(self) -> DataFrame:
        return cut(verify.retrieve(self.queries, self.corpus, K))

    @cached_property
    def index(self) -> TextIndex:
        """The chunks' stored index, built when a plan first searches it."""
        return TextIndex(self.spark, new_folder(self.spark)).add(self.terms)

    @cached_property
    def phrases(self) -> DataFrame:
        """Edges to concepts of several words."""
        return cut(chunk_concepts(extract_concepts(self.chunks, PHRASE_RULES)))

    @cached_property
    def texts_asked(self) -> DataFrame:
        """Whole benchmark texts as queries."""
        return cut(self.benchmark.select(F.concat(F.lit("t"), F.col("item_id").cast("string")).alias("query_id"), F.coalesce("text", F.lit("")).alias("query")))

    def results(self) -> DataFrame:
        return self.found

    def fallback(self) -> DataFrame:
        return retrieval.fallback_results(self.queries, self.results(), self.chunks, K)

    def texts(self) -> DataFrame:
        return verify.materialise(verify.rank(self.queries, self.corpus, K), self.chunks)

    def verdicts(self) -> DataFrame:
        return verify.adjudicate(self.claims, self.corpus, K)


def _score(c: str = "score") -> Column:
    return F.round(c, 6).alias(c)


def _joined(c: str) -> Column:
    return F.array_join(c, ",").alias(c)


def bm25(i: Inputs) -> DataFrame:
    return retrieval.bm25_top_k(i.queries, i.terms, K).select("query_id", "chunk_id", _score(), "rank")


def indexed(score: str) -> Callable[[Inputs], DataFrame]:
    return lambda i: i.index.search(i.queries, K, score).select("query_id", "chunk_id", _score(), "rank")


def fuzzy_terms(i: Inputs) -> DataFrame:
    """Every query's terms and the tokens of the corpus near them."""
    asked = i.queries.select("query_id", F.explode(T.tokens(F.col("query"))).alias("asked"))
    near = fuzzy.near_terms(asked.select("asked").distinct(), i.index.vocabulary())
    return asked.join(near, "asked").select("query_id", "asked", "token", "distance")


def evidence_paths(i: Inputs) -> DataFrame:
    found = paths.evidence_paths(i.texts_asked, i.phrases, K)
    return found.select("query_id", "chunk_id", _score(), "rank", "length", F.array_join("path", " > ").alias("path"))


def cosine(i: Inputs) -> DataFrame:
    """Queries are the vectors whose id is divisible by 100; they meet every vector."""
    vectors = i.read("embeddings")
    asked = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = retrieval.vector_top_k(asked, vectors.select(F.col("vec_id").alias("chunk_id"), "embedding"), K)
    return found.select("query_id", "chunk_id", _score(), "rank")


def _vectors(i: Inputs) -> tuple[DataFrame, DataFrame]:
    """The vectors whose id is divisible by 100 as queries, and all vectors."""
    vectors = i.read("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return vectors.filter("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id"), vectors


def indexed_cosine(i: Inputs) -> DataFrame:
    """The same search through an index, by as many lists as its quantisers call for."""
    asked, vectors = _vectors(i)
    return VectorIndex(i.spark, new_folder(i.spark)).build(vectors).search(asked, 2 * K).select("query_id", "chunk_id", _score(), "rank")


def canonical(i: Inputs) -> DataFrame:
    """The driver's vectors as those of terms named by their ids; they are far apart, so the threshold is low."""
    term = F.concat(F.lit("T"), F.col("vec_id").cast("string"))
    return canonical_concepts(i.read("embeddings").select(term.alias("term"), "embedding"), ALIKE)


def indexed_recall(i: Inputs) -> DataFrame:
    """Per query how many of the ten nearest vectors the index finds, and how many vectors it looks at."""
    asked, vectors = _vectors(i)
    index = VectorIndex(i.spark, new_folder(i.spark)).build(vectors)
    return recall(index.search(asked, 2 * K), retrieval.vector_top_k(asked, vectors, 2 * K)).join(index.scanned(asked), "query_id")


def routed(i: Inputs) -> DataFrame:
    """Questions of every kind, made of whole benchmark texts."""
    n, text = F.col("item_id") % 5, F.col("text")
    query = (
        F.when(n == 0, F.concat(F.lit("What is CHEMBL"), (F.col("item_id") + 12345).cast("string"), F.lit("? "), text))
        .when(n == 1, F.concat(F.lit("How does climate affects "), text))
        .when(n == 2, F.concat(F.lit("What connects A indirectly to "), text))
        .when(n == 3, F.concat(F.lit("Does this violate the constraint "), text))
        .otherwise(text)
    )
    asked = i.benchmark.select(F.concat(F.lit("r"), F.col("item_id").cast("string")).alias("query_id"), query.alias("query"))
    return routing.route(asked).select("query_id", "query", _joined("query_types"))


def graph(i: Inputs) -> DataFrame:
    return retrieval.graph_top_k(i.queries, i.corpus.edges, retrieval.lexical_top_k(i.queries, i.terms_once, K), K).select("query_id", "chunk_id", _score(), "rank")


def graph_fallback(i: Inputs) -> DataFrame:
    """Graph results of the queries that name no concept."""
    lost = i.queries.join(retrieval.match_concepts(i.queries, i.corpus.edges).select("query_id").distinct(), "query_id", "left_anti")
    return retrieval.graph_top_k(lost, i.corpus.edges, retrieval.lexical_top_k(lost, i.terms_once, K), K).select("query_id", "chunk_id", _score(), "rank")


def bipartite(i: Inputs) -> DataFrame:
    """Paths of up to three edges between concepts and chunks, where only odd lengths reach a chunk."""
    return retrieval.top_k(retrieval.graph_candidates(i.queries, i.corpus.edges, K, max_hops=2, step=2), K).select("query_id", "chunk_id", _score(), "rank")


def hinted(i: Inputs) -> DataFrame:
    """The judge's gate where every third chunk has a graph summary that names an edge."""
    hint = F.when(F.col("pos") % 3 == 0, F.array(F.concat("chunk_id", F.lit(" -> next")), F.lit(" ")))
    corpus = verify.Corpus(i.chunks.withColumn("graph_summary", hint), DATA_RULES)
    return verify.adjudicate(i.claims, corpus, K).select("assertion_id", "needs_judge", _joined("graph_summary"))


def gated(i: Inputs) -> DataFrame:
    """Only results of the retrievers that a query's types call for."""
    return routing.gated_results(i.results(), routing.route(i.queries)).select("query_id", "chunk_id", _score(), "source", "rank")


def fused(i: Inputs) -> DataFrame:
    return fusion.fuse(i.results().unionByName(i.fallback())).select("query_id", "chunk_id", _score(), _joined("sources"), "n_sources")


def flagged(i: Inputs) -> DataFrame:
    return verify.evidence(i.claims, i.corpus, K)


def violations(i: Inputs) -> DataFrame:
    return ontology.ontology_violations(i.texts(), i.claims).select("query_id", "rank", "assertion_id", "chunk_id", "violation_type", "confidence")


def examples(i: Inputs) -> DataFrame:
    return export.training_examples(verdict.final_columns(i.verdicts())).select("example_id", "task", "chunk_id", "input.chunk_text", "output.label", "output.score_bucket", "output.rationale")


def embedded(i: Inputs) -> DataFrame:
    return chunking.embed_chunks(i.fresh_chunks).select("chunk_id", F.array_join(F.transform("embedding", lambda x: F.format_string("%.4f", x)), ",").alias("embedding"))


QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {
    "chunk_documents": lambda i: i.fresh_chunks,
    "ingest_summary": lambda i: chunking.ingest_summary(i.fresh_chunks),
    "token_index": lambda i: chunking.token_index(i.fresh_chunks),
    "document_frequency": lambda i: chunking.document_frequency(chunking.token_index(i.fresh_chunks)),
    "claims": lambda i: i.claims,
    "lexical_topk": lambda i: retrieval.lexical_top_k(i.queries, i.terms_once, K),
    "jaccard_topk": lambda i: retrieval.jaccard_top_k(i.queries, i.terms_once, K).select("query_id", "chunk_id", _score(), "rank"),
    "bm25_topk": bm25,
    "bm25_fuzzy": lambda i: retrieval.bm25_top_k(i.queries, i.chunks, K, fuzzy=True).select("query_id", "chunk_id", _score(), "rank"),
    "fuzzy_terms": fuzzy_terms,
    "bm25_indexed": indexed("bm25"),
    "overlap_indexed": indexed("overlap"),
    "jaccard_indexed": indexed("jaccard"),
    "index_blocks": lambda i: i.index.blocks_read(i.queries, K),
    "cosine_topk": cosine,
    "vector_index_topk": indexed_cosine,
    "vector_index_recall": indexed_recall,
    "concept_edges": lambda i: i.corpus.edges,
    "concept_match": lambda i: retrieval.match_concepts(i.queries, i.corpus.edges),
    "graph_scores": lambda i: retrieval.graph_candidates(i.queries, i.corpus.edges, None).select("query_id", "chunk_id", _score()),
    "graph_topk": graph,
    "graph_fallback": graph_fallback,
    "graph_bipartite": bipartite,
    "canonical_concepts": canonical,
    "concept_seeds": lambda i: paths.scored_seeds(i.texts_asked, i.phrases).select("query_id", "concept", _score()),
    "graph_scored": lambda i: paths.scored_graph_top_k(i.texts_asked, i.phrases, K).select("query_id", "chunk_id", _score(), "rank"),
    "evidence_paths": evidence_paths,
    "gated_results": gated,
    "judge_gate_graph": hinted,
    "retrieval_union": lambda i: i.results().select("query_id", "chunk_id", _score(), "source", "src_ord", "rank"),
    "fallback_candidates": lambda i: i.fallback(),
    "fusion_scores": fused,
    "fusion_topk": lambda i: verify.rank(i.queries, i.corpus, K).select("query_id", "chunk_id", _score(), "source", _joined("contributing_sources"), "rank"),
    "materialize_chunks": lambda i: i.texts().select("query_id", "chunk_id", "document_id", "text", "rank"),
    "route_queries": routed,
    "match_flags": lambda i: flagged(i).select("assertion_id", "chunk_id", "matched_subject", "matched_relation", "matched_object"),
    "negation_flags": lambda i: flagged(i).select("assertion_id", "chunk_id", "negated", "negated_triple"),
    "span_stance": lambda i: flagged(i).select("assertion_id", "chunk_id", "support_type", "confidence"),
    "triple_classify": lambda i: stance.classify_triples(flagged(i).drop("confidence")).select("assertion_id", "chunk_id", "label", "confidence"),
    "verify_evidence": lambda i: verify.verify(i.queries, i.corpus, K),
    "verdict_aggregate": lambda i: i.verdicts().select("assertion_id", "label", "score", "rationale", _joined("retrieval_sources")),
    "rule_hits": lambda i: i.verdicts().select("assertion_id", _joined("rule_hits")),
    "judge_gate": lambda i: i.verdicts().select("assertion_id", "needs_judge"),
    "judge_heuristic": lambda i: i.verdicts().select("assertion_id", "judge_label", "judge_confidence", "judge_rationale"),
    "verdict_merge": lambda i: verdict.final_columns(i.verdicts()).select("assertion_id", "subject", "relation", "object", "label", "score", "rationale", _joined("rule_hits")),
    "verdict_summary": lambda i: verdict.summary(verdict.final_columns(i.verdicts())),
    "score_bucket": lambda i: verdict.final_columns(i.verdicts()).select("assertion_id", "score", verdict.score_bucket(F.col("score")).alias("score_bucket")),
    "training_examples": examples,
    "svo_extract": lambda i: svo.extract_relations(i.fresh_chunks, DATA_RELATIONS).select("chunk_id", "subject_id", "relation", "object_id"),
    "svo_edges": lambda i: svo.entity_edges(svo.extract_relations(i.fresh_chunks, DATA_RELATIONS)),
    "svo_mentions": lambda i: svo.mentions(svo.extract_relations(i.fresh_chunks, DATA_RELATIONS)),
    "simple_embedding": embedded,
    "ontology_violations": violations,
}


def _plain(df: DataFrame) -> DataFrame:
    """Integers as longs, so that both engines' types agree."""
    return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, f=f: _plain(f(Inputs(spark, sf_dir))) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return oracle.sql()


FLAGSHIP = queries()["verdict_merge"]
