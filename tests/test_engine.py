"""Behaviour of the engine on small texts."""

import json

import pytest
from pyspark.sql import functions as F

from veriframe.functions import text as T
from veriframe.operators import chunking, concepts, export, fusion, models, ontology, retrieval, routing, stance, svo, verdict
from veriframe.plans import verify
from veriframe.plans.claims import with_defaults
from veriframe.plans.engine import VerificationEngine
from veriframe.sources import assertions, health, stores
from veriframe.sources.settings import Settings
from veriframe.streaming.ingest import document_stream, ingest_stream

ASPIRIN = "Aspirin treats headache. Aspirin does not treat malaria."


def documents(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "document_id string, raw_text string")


def claims(spark, *triples, polarity="must_hold"):
    rows = [(f"t{k}", *t, polarity) for k, t in enumerate(triples)]
    return with_defaults(spark.createDataFrame(rows, "assertion_id string, subject string, relation string, object string, polarity string"))


def test_worked_verdicts(spark):
    corpus = verify.Corpus(chunking.chunk_documents(documents(spark, d=ASPIRIN)))
    asked = claims(spark, ("Aspirin", "treats", "headache"), ("Aspirin", "treats", "malaria"), ("Aspirin", "treat", "malaria"), ("Water", "regulates", "growth"))
    verdicts = verify.validate_batch(asked, corpus)
    got = {r.assertion_id: (r.label, r.score, list(r.rule_hits)) for r in verdicts.collect()}
    judged = ["evidence_judge", "heuristic_baseline", "lm_judge"]
    assert got["t0"] == ("supported", 1.0, ["direct_support", *judged, "partial_match"])
    assert got["t1"] == ("partial", 0.6325, [*judged, "partial_match"])
    assert got["t2"] == ("contradicted", 0.8, ["evidence_judge", "explicit_negation", "heuristic_baseline", "lm_judge", "partial_match"])
    assert got["t3"] == ("unknown", 0.2, ["evidence_judge", "heuristic_baseline", "insufficient_evidence", "lm_judge"])
    assert verdict.summary(verdicts).first().asDict() == {"total_triples": 4, "supported": 1, "contradicted": 1, "partial": 1, "unknown": 1, "avg_score": 0.6581}


@pytest.mark.parametrize(
    ("text", "pieces"),
    [
        ("line one\nline two. x? y", ["line two.", "x?"]),
        ("One sentence.[62] Two here![a][b] tail without end", ["One sentence.[62]", "Two here![a][b]"]),
        ("no end", ["no end"]),
        ("", [""]),
        (None, [""]),
        ("  \n ", ["  \n "]),
        (". A b.", [". A b."]),
    ],
)
def test_chunks(spark, text, pieces):
    df = spark.createDataFrame([("d", text)], "document_id string, raw_text string")
    assert [r.text for r in chunking.chunk_documents(df).orderBy("pos").collect()] == pieces


def test_chunks_with_tails_and_long_lines(spark):
    df = documents(spark, d="A b. c d")
    assert [r.text for r in chunking.chunk_documents(df, keep_tails=True).orderBy("pos").collect()] == ["A b.", "c d"]
    assert chunking.chunk_documents(documents(spark, d="w%% " * 100_000)).count() == 1


def test_fusion_example(spark):
    rows = [("q", "c1", 0.5, "lexical", 0, 1), ("q", "c1", 0.7, "semantic", 1, 1), ("q", "c2", 0.6, "lexical", 0, 2)]
    got = {r.chunk_id: r.score for r in fusion.fuse(spark.createDataFrame(rows, "query_id string, chunk_id string, score double, source string, src_ord int, rank int")).collect()}
    assert got == pytest.approx({"c1": 0.45, "c2": 0.3})


def test_fusion_ties_keep_first_seen_order(spark):
    rows = [("q", "b", 0.0, "fallback", 0, 1), ("q", "a", 0.0, "fallback", 0, 2), ("q", "c", 0.0, "fallback", 0, 3)]
    ranked = fusion.fuse_and_rank(spark.createDataFrame(rows, "query_id string, chunk_id string, score double, source string, src_ord int, rank int"), 2)
    assert [(r.chunk_id, r.contributing_sources) for r in ranked.orderBy("rank").collect()] == [("b", ["fallback"]), ("a", ["fallback"])]


def test_routing(spark):
    rows = [("1", "What is CHEMBL12345?"), ("2", "How does climate change affect agriculture?"), ("3", "What connects A indirectly to B?"), ("4", "Does this violate the constraint?"), ("5", "it affects x via y")]
    got = {r.query_id: r.query_types for r in routing.route(spark.createDataFrame(rows, "query_id string, query string")).collect()}
    assert got == {"1": ["exact_match"], "2": ["complex", "exact_match"], "3": ["multi_hop"], "4": ["ontology"], "5": ["complex", "multi_hop"]}


def test_graph_reaches_over_shared_concepts(spark):
    text = "Controller type is above the worker type. The worker resolution pathway is determined by its manager."
    corpus = verify.Corpus(chunking.chunk_documents(documents(spark, d=text)))
    asked = spark.createDataFrame([("q", "hierarchy levels")], "query_id string, query string")
    hits = {r.chunk_id: r.score for r in retrieval.graph_candidates(asked, corpus.edges, 5).collect()}
    assert hits == {"d-000000": 1.0, "d-000001": 1.0}
    one = spark.createDataFrame([("q", "resolution pathway")], "query_id string, query string")
    hits = {r.chunk_id: r.score for r in retrieval.graph_candidates(one, corpus.edges, 5).collect()}
    assert hits == {"d-000001": 1.0, "d-000000": 0.8}
    paths = {r.chunk_id: round(r.score, 4) for r in retrieval.graph_candidates(one, corpus.edges, 5, step=2).collect()}
    assert paths == {"d-000001": 1.0, "d-000000": 0.64}


@pytest.mark.parametrize("most", [100_000, 0])
def test_graph_pairs_are_not_dealt_by_concept(spark, monkeypatch, most):
    """A concept that every chunk has isn't one task's, whether the queries' concepts are broadcast or not."""
    edges = spark.range(400).selectExpr("concat('c', id) AS chunk_id", "explode(IF(id = 7, array('hot', 'rare'), array('hot'))) AS concept", "'PROVIDES' AS edge_type")
    asked = spark.createDataFrame([("q1", "so hot"), ("q2", "a rare one")], "query_id string, query string")
    monkeypatch.setattr(retrieval, "is_small", lambda df: most > 0)
    found = retrieval.graph_candidates(asked, edges, None)
    assert {(r.query_id, r.chunk_id): round(r.score, 2) for r in found.collect()} == {
        ("q1", "c7"): 1.0, ("q2", "c7"): 1.0, **{("q1", f"c{k}"): 1.0 for k in range(400) if k != 7}, **{("q2", f"c{k}"): 0.8 for k in range(400) if k != 7}
    }
    if most:
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(concept" not in plan.replace("#", " ").replace("concept ", "concept") and "hashpartitioning(query_id" not in plan


def test_retrievers_read_tokens_once(spark):
    """Both token searches read the tokens that are asked for, and no others; results are those of all tokens."""
    texts = spark.createDataFrame([("a", "red fox and red hen"), ("b", "fox"), ("c", "nothing here"), ("d", None), ("e", "hen and fox in the barn")], "chunk_id string, text string")
    asked = spark.createDataFrame([("q1", "Fox hen"), ("q2", "zebra"), ("q3", "red barn owl")], "query_id string, query string")
    made = retrieval.asked_tokens(asked, chunking.tokenised(texts))
    assert {r.chunk_id: (r.n_tokens, sorted(r.tokens)) for r in made.documents.collect()} == {"a": (4, ["fox", "hen", "red"]), "b": (1, ["fox"]), "e": (6, ["barn", "fox", "hen"])}
    lexical = {(r.query_id, r.chunk_id): r.score for r in retrieval.lexical_top_k(asked, None, 5, made).collect()}
    assert lexical == {("q1", "a"): 2, ("q1", "e"): 2, ("q1", "b"): 1, ("q3", "e"): 1, ("q3", "a"): 1}
    jaccard = {(r.query_id, r.chunk_id): round(r.score, 4) for r in retrieval.jaccard_top_k(asked, None, 5, made).collect()}
    assert jaccard == {("q1", "a"): 0.5, ("q1", "e"): 0.3333, ("q1", "b"): 0.5, ("q3", "e"): 0.125, ("q3", "a"): 0.1667}


def test_both_token_searches_meet_a_pair_once(spark):
    """One search gives what the two give one by one, for queries of few and of many pairs."""
    words = ["fox", "hen", "red", "barn", "owl"]
    texts = spark.createDataFrame([(f"c{n:02}", " ".join(w for k, w in enumerate(words) if n >> k & 1) + " x" * (n % 3)) for n in range(32)], "chunk_id string, text string")
    asked = spark.createDataFrame([("q1", "fox hen"), ("q2", "zebra"), ("q3", "red barn owl"), ("q4", "x")], "query_id string, query string")
    terms = chunking.tokenised(texts)
    both = retrieval.overlap_searches(asked, terms, 3)
    assert list(both) == ["lexical", "jaccard"]
    for kind, alone in (("lexical", retrieval.lexical_top_k), ("jaccard", retrieval.jaccard_top_k)):
        want = alone(asked, terms, 3)
        assert both[kind].columns == want.columns and both[kind].count() == 9
        assert sorted(both[kind].collect()) == sorted(want.collect())
    queries, chunks = {r.query_id: set(r.query.split()) for r in asked.collect()}, {r.chunk_id: set((r.text or "").split()) for r in texts.collect()}
    for q, w in queries.items():
        best = sorted(((len(w & t) / len(w | t), c) for c, t in chunks.items() if w & t), reverse=True)[:3]
        assert [(r.score, r.chunk_id) for r in both["jaccard"].filter(F.col("query_id") == q).orderBy("rank").collect()] == best


def test_scores_that_differ_little_are_ranked(spark):
    """The second round's chunk is better by 4.4e-7 and has the smaller id."""
    long = lambda word, n: " ".join([word, *(f"w{k}" for k in range(n - 1))])
    texts = spark.createDataFrame([("z", long("rare", 1501)), ("a", long("common", 1500)), ("b", long("common", 1600))], "chunk_id string, text string")
    asked = spark.createDataFrame([("q", "rare common")], "query_id string, query string")
    found = retrieval.jaccard_top_k(asked, chunking.tokenised(texts), 1).collect()
    assert [(r.chunk_id, r.score) for r in found] == [("a", 1 / 1501)]


def test_needles_are_looked_for_in_one_lower_text(spark):
    chunks = spark.createDataFrame([("a", "The HIERARCHY"), ("b", "none"), ("c", None)], "chunk_id string, text string")
    possible = concepts.possible_chunks(chunks)
    assert [r.chunk_id for r in possible.collect()] == ["a"]
    assert possible._jdf.queryExecution().optimizedPlan().toString().count("lower(text") == 1


def test_texts_are_lowered_once_for_all_needles(spark):
    chunks = spark.createDataFrame([("a", "The HIERARCHY"), ("b", "none"), ("c", None), ("d", "Controller type, resolution pathway")], "chunk_id string, text string")
    described = concepts.extract_concepts(chunks)
    assert described.columns == ["chunk_id", "text", "provides", "depends_on"]
    assert {r.chunk_id: (r.provides, r.depends_on) for r in described.collect()} == {"a": (["hierarchy"], []), "b": ([], []), "c": ([], []), "d": (["hierarchy", "resolution pathway"], ["hierarchy"])}
    assert described._jdf.queryExecution().optimizedPlan().toString().count("lower(text") == 1
    assert {r.chunk_id for r in concepts.possible_chunks(chunks).collect()} == {"a", "d"}


def test_sentence_ends_and_trims(spark):
    """White space of any kind is trimmed, and a terminator that begins a line ends nothing."""
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F] + ["\u3000"]
    rows = spark.createDataFrame([(s + "x" + s + "y" + s,) for s in set(spaces)], "t string").select("t", T.strip(F.col("t")).alias("u"), F.regexp_replace("t", r"(?U)^\s+|\s+\z", "").alias("v")).collect()
    assert len(rows) == len(set(spaces)) and all(r.u == r.v == r.t[1:-1] for r in rows)
    texts = ["One. Two![1] three", ".a. b", "x\n. y.\n?[2] z? ", "\U0001f600. b.[3][4]\u3000c.", "!!! a.b ?"]
    old = r"(?U)(?<=[^\n])([.!?](?:\[[^\]\n]*\])*)(?=\s|\z)"
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.regexp_replace("t", T.SENTENCE_END, "$1|").alias("a"), F.regexp_replace("t", old, "$1|").alias("b")).collect()
    assert all(r.a == r.b for r in got)


def test_bm25_fuzzy(spark):
    chunks = chunking.chunk_documents(documents(spark, a="aspirin treats headache.", b="water helps growth."))
    asked = spark.createDataFrame([("q", "asprin")], "query_id string, query string")
    assert retrieval.bm25_top_k(asked, chunks, 5).count() == 0
    assert [r.chunk_id for r in retrieval.bm25_top_k(asked, chunks, 5, fuzzy=True).collect()] == ["a-000000"]


def test_polarity_and_negation(spark):
    flagged = stance.match_flags(claims(spark, ("Aspirin", "treats", "headache"), polarity="must_not_hold").withColumns({"text": F.lit("Aspirin treats headache."), "score": F.lit(0.1), "chunk_id": F.lit("c")}))
    row = stance.span_stance(flagged).first()
    assert (row.support_type, row.confidence) == ("refutes", 0.9)
    assert stance.classify_triples(flagged).first().label == "supported"
    assert ontology.score_violations(flagged.withColumn("polarity", F.lit("forbidden"))).first().violation_type == "contradiction"
    negated = stance.match_flags(claims(spark, ("Aspirin", "treat", "malaria")).withColumn("text", F.lit("Aspirin fails to treat malaria")))
    assert (negated.first().negated, negated.first().negated_triple) == (True, False)


def test_empty_part_never_matches(spark):
    row = stance.match_flags(claims(spark, ("", "treats", "headache")).withColumn("text", F.lit("treats headache"))).first()
    assert (row.matched_subject, row.matched_relation) == (False, True)


def test_no_judge_for_strong_single_source(spark):
    entry = "array<struct<rank:int,chunk_id:string,text:string,support_type:string,confidence:double,retrieval_score:double,contributing_sources:array<string>,matched_subject:boolean,matched_relation:boolean,matched_object:boolean>>"
    schema = f"assertion_id string, subject string, relation string, object string, polarity string, rule_type string, evidence {entry}"
    support = (1, "c1", "x", "supports", 0.95, 0.9, ["lexical"], True, True, True)
    partial = (1, "c2", "y", "partial", 0.5, 0.42, ["lexical"], True, False, False)
    df = spark.createDataFrame([("a", "s", "r", "o", "must_hold", "c", [support]), ("b", "s", "r", "o", "must_hold", "c", [partial]), ("n", "s", "r", "o", "must_hold", "c", [])], schema)
    got = {r.assertion_id: r for r in verdict.merge(verdict.judge(verdict.judge_gate(verdict.aggregate(df)))).collect()}
    assert (got["a"].needs_judge, got["a"].final_label, got["a"].final_score, got["a"].judge_label) == (False, "supported", 0.8, None)
    assert (got["b"].needs_judge, got["b"].judge_label, got["b"].final_score) == (True, "partial", 0.55)
    assert (got["n"].label, got["n"].score, got["n"].rule_hits) == ("unknown", 0.1, ["no_evidence"])


def test_model_columns_and_fallback(spark):
    rows = claims(spark, ("Aspirin", "treats", "headache")).withColumns({"text": F.lit("Aspirin treats headache."), "score": F.lit(0.0)})
    flagged = stance.match_flags(rows)
    sure = models.nli_stances(flagged, lambda: lambda texts: [[0.1, 0.2, 0.7]] * len(texts)).first()
    assert (sure.support_type, sure.confidence) == ("refutes", 0.7)

    def broken():
        raise OSError("no model")

    assert models.nli_stances(flagged, broken).first().support_type == "supports"
    assert models.zero_shot_triples(flagged, lambda: lambda texts: ["refutes"] * len(texts)).first().label == "contradicted"


def test_judge_answers(spark):
    rows = spark.createDataFrame([("Supported.",), ("it may refute",), ("partially true",), ("??",), (None,)], "a string")
    assert [r[0] for r in rows.select(verdict.parse_judge_label(F.col("a"))).collect()] == ["supported", "contradicted", "partial", None, None]
    p = spark.createDataFrame([([0.5, 0.5],), ([],), ([0.01],)], "p array<double>")
    assert [r[0] for r in p.select(verdict.sequence_confidence(F.col("p"))).collect()] == [0.5, 0.6, 0.3]


def test_concepts_and_relations(spark):
    chunks = spark.createDataFrame([("1", "A HIERARCHY of levels"), ("2", "resolution pathway"), ("3", "none")], "chunk_id string, text string")
    got = {r.chunk_id: (r.provides, r.depends_on) for r in concepts.extract_concepts(chunks).collect()}
    assert got == {"1": (["hierarchy"], []), "2": (["resolution pathway"], ["hierarchy"]), "3": ([], [])}
    named = spark.createDataFrame([("1", ["  HIERARCHY  ", "hierarchy"], None)], "chunk_id string, provides array<string>, depends_on array<string>")
    assert [tuple(r) for r in concepts.chunk_concepts(named).collect()] == [("1", "hierarchy", "PROVIDES")]
    drug = spark.createDataFrame([("1", "Aspirin treats fever")], "chunk_id string, text string")
    assert [r.relation for r in svo.extract_relations(drug).collect()] == ["TREATS", "REDUCES"]
    made = spark.createDataFrame([("1", "Vitamin C, is-part of, Diet"), ("2", "x, y")], "chunk_id string, generated string")
    assert [(r.subject_id, r.relation, r.object_id) for r in svo.parse_relations(made).collect()] == [("ent_vitamin_c", "IS-PART OF", "ent_diet")]


def test_canonical_concepts(spark):
    terms = spark.createDataFrame([("Cache layer", [1.0, 0.0]), ("cache", [0.99, 0.01]), ("tree", [0.0, 1.0])], "term string, embedding array<double>")
    assert {r.term: r.canonical for r in concepts.canonical_concepts(terms).collect()} == {"Cache layer": "cache", "cache": "cache", "tree": "tree"}


def test_store_upsert_and_engine(spark, tmp_path):
    engine = VerificationEngine(spark, str(tmp_path / "store"))
    counts, verdicts, total = engine.validate_batch(documents(spark, d=ASPIRIN), claims(spark, ("Aspirin", "treats", "headache")))
    assert counts.first().asDict() == {"document_id": "d", "status": "success", "chunks": 2, "svos": 1}
    assert verdicts.first().label == "supported" and total.first().total_triples == 1
    assert len(engine.store.folders()) == 1
    engine.ingest(documents(spark, f="Aspirin treats fever."))  # new: appended
    assert len(engine.store.folders()) == 2 and engine.store.chunks().count() == 3
    assert spark.read.parquet(str(tmp_path / "store/entity_edges")).count() == 2
    engine.ingest(documents(spark, d=ASPIRIN, e="Water."))  # d again: written whole
    assert len(engine.store.folders()) == 1 and engine.store.chunks().count() == 4
    assert spark.read.parquet(str(tmp_path / "store/vectors")).count() == 4
    ids = spark.createDataFrame([("e-000000",), ("missing",)], "chunk_id string")
    assert [r.text for r in engine.store.get_chunks(ids).collect()] == ["Water."]
    engine.export_examples(claims(spark, ("Aspirin", "treats", "headache")), str(tmp_path / "examples"))
    row = spark.read.json(str(tmp_path / "examples")).first()
    assert row.example_id == "ex_t0_d-000000" and row.output.score_bucket == "very_high"
    assert engine.health().overall == "DEGRADED" and engine.health({"neo4j": lambda: 1}).overall == "HEALTHY"
    assert engine.verify(spark.createDataFrame([("q", "headache")], "query_id string, query string")).first().chunk_id == "d-000000"


def test_verify_with_ontology(spark):
    corpus = verify.Corpus(chunking.chunk_documents(documents(spark, d=ASPIRIN)))
    asked = spark.createDataFrame([("q", "aspirin malaria")], "query_id string, query string")
    status, none = verify.verify_with_ontology(asked, corpus, None)
    assert status.first().status == "ONTOLOGY_VALIDATION_SKIPPED" and none is None
    status, found = verify.verify_with_ontology(asked, corpus, claims(spark, ("Aspirin", "treat", "malaria")))
    assert status.first().status == "ONTOLOGY_VALIDATED"
    assert [(r.rank, r.violation_type) for r in found.orderBy("rank").collect()][0] == (1, "contradiction")


def test_streaming_ingest(spark, tmp_path):
    documents(spark, d=ASPIRIN).write.parquet(str(tmp_path / "in"))
    stream = document_stream(spark, str(tmp_path / "in"), documents(spark, d="").schema)
    ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert stores.ChunkStore(spark, str(tmp_path / "out/chunks")).chunks().count() == 2


def test_assertion_strings(spark):
    got = assertions.parse_triples(spark, [" a | b |c", "x|y", "d|e|f|g"]).collect()
    assert [tuple(r) for r in got] == [("t0", "a", "b", "c"), ("t2", "d", "e", "f")]
    got = assertions.parse_assertions(spark, ["x|y", " a|b|c", "d|e|f|must_not_hold"]).collect()
    assert [tuple(r) for r in got] == [("claim_1", " a", "b", "c", "must_hold"), ("claim_2", "d", "e", "f", "must_not_hold")]


def test_settings_and_metadata(spark, tmp_path):
    s = Settings.from_environment({"ONTO_ES_ENABLED": "TRUE", "ONTO_ES_PORT": "9", "ONTO_NEO4J_PASSWORD": "x"})
    assert (s.backend_mode, s.elasticsearch.enabled, s.elasticsearch.port) == ("auto", True, 9)
    s.save(str(tmp_path / "c.json"))
    assert Settings.load(str(tmp_path / "c.json")) == s and json.loads(s.to_json(redact=True))["neo4j"]["password"] == "***"
    with pytest.raises(ValueError):
        Settings(backend_mode="other")
    rows = spark.createDataFrame([('{"provides": ["a"]}',), ("broken{",), (None,)], "metadata string")
    assert [r[0] for r in rows.select(stores.parse_metadata()["provides"]).collect()] == [["a"], [], []]


def test_health_report():
    report = health.check({"store": lambda: 1 / 0, "neo4j": None})
    assert report.overall == "FAILED" and "disabled" in report.to_markdown() and json.loads(report.to_json())["backends"]["store"]["error"]


def test_example_of_empty_evidence(spark):
    corpus = verify.Corpus(chunking.chunk_documents(documents(spark, d=ASPIRIN).limit(0)))
    verdicts = verify.validate_batch(claims(spark, ("a", "b", "c")), corpus)
    row = export.training_examples(verdicts).first()
    assert (row.chunk_id, row.output.label, row.input.chunk_text) == ("unknown_chunk", "unknown", "")
    assert T.MARK not in row.example_id
