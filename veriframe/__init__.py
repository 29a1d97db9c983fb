"""Claim verification over document corpora, on Spark. Names are imported when they are first used."""

from importlib import import_module

_HOMES = {
    "VerificationEngine": "plans.engine",
    "EnginePool": "plans.factory",
    "create_engine": "plans.factory",
    "Corpus": "plans.verify",
    "Settings": "sources.settings",
    "ChunkStore": "sources.stores",
    "Recorder": "sources.stores",
    "Rule": "operators.concepts",
    "RelationRule": "operators.svo",
    "BucketedStore": "sources.buckets",
    "TextIndex": "operators.text_index",
    "VectorIndex": "operators.vector_index",
    "ingest": "sources.stores",
    "chunk_documents": "operators.chunking",
    "embed_chunks": "operators.chunking",
    "extract_concepts": "operators.concepts",
    "canonical_concepts": "operators.concepts",
    "extract_relations": "operators.svo",
    "entity_edges": "operators.svo",
    "near_terms": "operators.fuzzy",
    "evidence_paths": "operators.paths",
    "scored_graph_top_k": "operators.paths",
    "lexical_top_k": "operators.retrieval",
    "jaccard_top_k": "operators.retrieval",
    "bm25_top_k": "operators.retrieval",
    "vector_top_k": "operators.retrieval",
    "graph_top_k": "operators.retrieval",
    "fuse_and_rank": "operators.fusion",
    "fuse": "operators.fusion",
    "route": "operators.routing",
    "gated_results": "operators.routing",
    "classify_triples": "operators.stance",
    "span_stance": "operators.stance",
    "collect_evidence": "operators.verdict",
    "aggregate": "operators.verdict",
    "summary": "operators.verdict",
    "judge": "operators.verdict",
    "few_shot_judge": "operators.models",
    "nli_judge": "operators.models",
    "zero_shot_triples": "operators.models",
    "nli_stances": "operators.models",
    "transformer_embeddings": "operators.models",
    "gathered_evidence": "operators.ontology",
    "validated_evidence": "operators.ontology",
    "ontology_violations": "operators.ontology",
    "training_examples": "operators.export",
}
__all__ = list(_HOMES)


def __getattr__(name: str):
    if name not in _HOMES:
        raise AttributeError(f"{__name__} has no {name}")
    return getattr(import_module(f"{__name__}.{_HOMES[name]}"), name)
