"""Judges, extractors and engines backed by models, with stand-ins for the models."""

import pytest
from pyspark.sql import functions as F

import veriframe
from veriframe.operators import models, ontology, routing, stance, verdict
from veriframe.plans import factory, verify
from veriframe.sources import shared
from veriframe.sources.settings import Backend, Settings
from veriframe.sources.stores import Recorder, bulk_index, create_index, graph_schema, parse_metadata

CLAIM = "assertion_id string, subject string, relation string, object string, polarity string, rule_type string"


def _broken():
    def load():
        raise OSError("no model")

    return load


broken = _broken()


@pytest.fixture(scope="module")
def gated(spark):
    """One claim with a partial chunk that has graph lines, and one without evidence."""
    claims = spark.createDataFrame([("a", "Aspirin", "treats", "headache", "must_hold", "constraint"), ("n", "x", "y", "z", "must_hold", "constraint")], CLAIM)
    row = spark.createDataFrame([("a", 1, "c1", "Aspirin is a drug.", 0.42, ["lexical"], ["drug -> pain", "x"])], "assertion_id string, rank int, chunk_id string, text string, score double, contributing_sources array<string>, graph_summary array<string>")
    stances = stance.span_stance(stance.match_flags(row.join(claims, "assertion_id")))
    return verdict.judge_gate(verdict.aggregate(verdict.collect_evidence(claims, stances)))


def test_prompts(gated):
    few, nli = gated.filter("assertion_id = 'a'").select(models.few_shot_prompt(), models.nli_prompt()).first()
    assert few.startswith(models.INSTRUCTIONS + f"\n\nExample 1:\nClaim: {models.EXAMPLES[0][0]}\nEvidence:\n- [m1] fusion score=0.880 support=supports:")
    assert few.endswith("Now classify the following:\nClaim: Aspirin treats headache\nEvidence:\n- [c1] fusion score=0.420 support=partial: Aspirin is a drug.\nGraph summary: drug -> pain; x\nLabel:")
    assert few.count("Graph summary: none\nLabel: ") == 4
    assert nli == "Assertion: Aspirin treats headache\nPolarity: must_hold\nRule type: constraint\nEvidence:\n- [c1] fusion score=0.420 support=partial: Aspirin is a drug.\nGraph summary:\n- drug -> pain\n- x"
    few, nli = gated.filter("assertion_id = 'n'").select(models.few_shot_prompt(), models.nli_prompt()).first()
    assert "Evidence:\n- none\nGraph summary: none" in few and nli.endswith("Evidence:\n\nGraph summary:\n- none")


def test_few_shot_judge(gated):
    answers = lambda texts: [("Entailment", [0.5, 0.5]) for _ in texts]
    got = {r.assertion_id: r for r in models.few_shot_judge(gated, lambda: answers).collect()}
    assert (got["a"].judge_label, got["a"].judge_confidence, got["a"].judge_rationale) == ("supported", 0.5, "Few-shot LM judge selected 'supported' from the evidence pack.")
    assert got["a"].judge_graph_reasoning == "drug -> pain; x" and got["n"].judge_graph_reasoning is None and got["a"].judge_evidence_ids == []
    plain = {r.assertion_id: r for r in verdict.judge(gated).collect()}
    got = {r.assertion_id: r for r in models.few_shot_judge(gated, lambda: lambda texts: [("Well?", []) for _ in texts]).collect()}
    assert got["a"].judge_label == plain["a"].judge_label == "partial" and got["a"].judge_rationale == plain["a"].judge_rationale + " Few-shot LM judge produced unparsable output: 'well?'"
    got = {r.assertion_id: r for r in models.few_shot_judge(gated, broken).collect()}
    assert all((got[k].judge_label, got[k].judge_rationale) == (plain[k].judge_label, plain[k].judge_rationale) for k in plain)
    assert verdict.merge(models.few_shot_judge(gated, lambda: answers)).filter("assertion_id = 'a'").first().final_label == "supported"


def test_nli_judge(gated):
    got = {r.assertion_id: r for r in models.nli_judge(gated, lambda: lambda texts: [("contradicted", [0.77]) for _ in texts]).collect()}
    assert (got["a"].judge_label, got["a"].judge_confidence, got["a"].judge_rationale) == ("contradicted", 0.77, "LM judge selected 'contradicted' from the evidence pack.")
    assert models.nli_judge(gated, broken).filter("assertion_id = 'n'").first().judge_label == "unknown"


def test_graph_lines_reach_the_gate(spark):
    assert [r.needs_judge for r in verdict.judge_gate(spark.createDataFrame([("supported", 0.9, [1], [], ["lexical"], [t]) for t in ("a -> b", "PROVIDES x", "plain")], "label string, score double, supports array<int>, refutes array<int>, retrieval_sources array<string>, graph_summary array<string>")).collect()] == [True, True, False]
    chunks = spark.createDataFrame([("c", "d", "Aspirin treats headache.", "  drug -> pain ")], "chunk_id string, document_id string, text string, graph_summary string")
    claims = spark.createDataFrame([("a", "Aspirin", "treats", "headache", "must_hold", "constraint")], CLAIM)
    assert verify.adjudicate(claims, verify.Corpus(chunks)).first().graph_summary == ["drug -> pain"]
    rows = spark.createDataFrame([('{"graph_summary": "a -> b"}',), ('{"graph_summary": ["a", " ", "b"]}',), ("{}",)], "metadata string")
    assert [r[0].graph_summary for r in rows.select(parse_metadata()).collect()] == [["a -> b"], ["a", "b"], []]


def test_concepts_by_prompt_and_json(spark):
    chunks = spark.createDataFrame([("1", "A cache stores data."), ("2", " "), ("3", None)], "chunk_id string, text string")

    def model(texts):
        return ["cache, a term of very many words that is dropped, cache" if "meaning" in t else "data" for t in texts]

    got = {r.chunk_id: (r.provides, r.depends_on) for r in models.generated_concepts(chunks, lambda: model).collect()}
    assert got == {"1": (["cache"], ["data"]), "2": ([], []), "3": ([], [])}
    settings = Settings(concept_extractor_name="json")
    answer = lambda: lambda texts: ['Here: {"provides": ["cache"]}' if t else "none" for t in texts]
    rows = factory.concepts_of(chunks, settings, {"concepts": answer}).collect()
    assert [(r.provides, r.depends_on) for r in rows][0] == (["cache"], [])
    assert factory.concepts_of(chunks, Settings(concept_extractor_name="transformer"), {"concepts": broken}).first().provides == []


def test_other_model_columns(spark):
    chunks = spark.createDataFrame([("1", "Aspirin treats fever")], "chunk_id string, text string")
    assert models.transformer_embeddings(chunks, lambda: lambda texts: [[1.0, 2.0]] * len(texts)).first().embedding == [1.0, 2.0]
    made = factory.relations_of(chunks, Settings(svo_extractor_name="transformer"), {"relations": lambda: lambda texts: ["a, helps, b"] * len(texts)})
    assert [(r.subject_id, r.object_id) for r in made.collect()] == [("ent_a", "ent_b")]
    assert factory.relations_of(chunks, Settings(svo_extractor_name="transformer"), {}).count() == 2
    results = spark.createDataFrame([("q", 1, "c", 0.5, "fusion", " ", "entailment", 0.98765)], "query_id string, rank int, chunk_id string, score double, source string, text string, label string, confidence double")
    r = ontology.validated_evidence(results).first()
    assert (r.label, r.confidence, r.status) == ("neutral", 0.0, "EVIDENCE_VALIDATED")


def test_gating(spark):
    routed = spark.createDataFrame([("q", ["complex"])], "query_id string, query_types array<string>")
    found = spark.createDataFrame([("q", "a", "lexical"), ("q", "b", "semantic"), ("q", "c", "graph")], "query_id string, chunk_id string, source string")
    assert [r.chunk_id for r in routing.gated_results(found, routed).collect()] == ["b"]


def test_factory_and_pool(spark, tmp_path):
    store = str(tmp_path / "store")
    assert factory.judge_of(Settings(enable_lm_judge=True), {"nli_judge": broken}) is verdict.judge
    assert factory.judge_of(Settings(enable_lm_judge=True), {"nli_judge": lambda: lambda texts: texts}).func is models.nli_judge
    with pytest.raises(RuntimeError, match="none is enabled"):
        factory.create_engine(spark, Settings(store_path=store, require_production_backends=True))
    needed = Settings(store_path=store, require_production_backends=True, neo4j=Backend(enabled=True))
    with pytest.raises(RuntimeError, match="neo4j"):
        factory.create_engine(spark, needed, pings={"neo4j": broken})
    assert factory.create_engine(spark, needed, pings={"neo4j": lambda: 1}).path == store

    def build(session, settings):
        if settings.svo_extractor_name == "transformer":
            raise OSError("no model")
        return factory.create_engine(session, settings)

    pool = factory.EnginePool(spark, Settings(store_path=store), build)
    assert len(pool.engines) == 2 and pool.resolve("transformer") is pool.engines["transformer", "mock"]
    assert pool.resolve(None, "transformer") is pool.engines["simple", "mock"] is pool.resolve()
    assert [d["default"] for d in pool.diagnostics()] == [True, False]
    pool.clear()
    with pytest.raises(factory.NoEngine):
        pool.resolve()


def test_index_recorder_and_schema(spark, tmp_path):
    chunks = spark.createDataFrame([("c", "d", "Doctors treating it", 3)], "chunk_id string, document_id string, text string, word_count int")
    path = str(tmp_path / "index")
    assert bulk_index(chunks, path) == {"success": 1, "failed": 0} and not create_index(spark, path)
    assert spark.read.parquet(f"{path}/terms").first()["all"] == ["doctor", "treat"]
    assert spark.read.json(f"{path}/actions").first()["_id"] == "c"
    (tmp_path / "file").write_text("x")
    assert bulk_index(chunks, str(tmp_path / "file")) == {"success": 0, "failed": 1}
    recorder = Recorder()
    assert recorder.write(chunks) == 1 and recorder.rows[0]["chunk_id"] == "c"
    edges = spark.createDataFrame([("a", "R", "b"), ("a", "R", "b")], "s string, r string, o string")
    assert graph_schema(edges, edges.distinct()) == {"edges": False, "mentions": True}


def test_a_shorter_document_keeps_no_tail(spark, tmp_path):
    engine = veriframe.VerificationEngine(spark, str(tmp_path / "store"))
    schema = "document_id string, raw_text string"
    engine.ingest(spark.createDataFrame([("d", "One. Two. Three."), ("e", "Four.")], schema))
    engine.ingest(spark.createDataFrame([("d", "Only.")], schema))
    assert sorted(r.text for r in engine.store.chunks().collect()) == ["Four.", "Only."]


def test_exports():
    assert all(callable(getattr(veriframe, n)) for n in veriframe.__all__)


def test_shared_folder_on_a_cluster(spark):
    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session)
    kept = shared.cut(spark.range(3))
    assert kept.count() == 3
