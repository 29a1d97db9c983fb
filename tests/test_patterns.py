"""Pattern matching, concept matching and paths, against comparing everything."""

import random

import pytest
from veriframe.operators import patterns, paths, retrieval


@pytest.mark.parametrize("block", [100_000, 7])
def test_contained(spark, monkeypatch, block):
    monkeypatch.setattr(patterns, "BLOCK_PATTERNS", block)
    rng = random.Random(2)
    texts = [(k, "".join(rng.choices("abé ", k=rng.randint(0, 60)))) for k in range(200)] + [(500, None), (501, ""), (3, "ab"), (3, "ab")]
    needles = sorted({"".join(rng.choices("abé ", k=rng.randint(1, 6))) for _ in range(80)}) + ["", None, "ab", "ab"]
    got = patterns.contained(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in needles], "pattern string")).collect()
    want = sorted((i, n) for i, t in texts if t is not None for n in {x for x in needles if x is not None} if n in t)
    assert sorted(map(tuple, got)) == want


def test_no_patterns_or_texts(spark):
    texts, needles = spark.createDataFrame([(1, "abc")], "id long, text string"), spark.createDataFrame([("b",)], "pattern string")
    assert patterns.contained(texts, needles.limit(0)).collect() == [] and patterns.contained(texts.limit(0), needles).collect() == []


def test_concepts_match_both_ways_without_a_product(spark):
    edges = spark.createDataFrame([("1", c, "PROVIDES") for c in ("heart failure", "art", "kidney", "")] + [("2", "art", "DEPENDS_ON")], "chunk_id string, concept string, edge_type string")
    queries = spark.createDataFrame([("a", "Heart failure, early"), ("b", "kid"), ("c", "nothing"), ("d", None)], "query_id string, query string")
    found = retrieval.match_concepts(queries, edges)
    assert sorted(map(tuple, found.collect())) == [("a", ""), ("a", "art"), ("a", "heart failure"), ("b", ""), ("b", "kidney"), ("c", "")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


EDGES = [("c1", "red apple"), ("c1", "tree"), ("c2", "tree"), ("c2", "old forest"), ("c3", "old forest"), ("c3", "owl"), ("c4", "green apple pie"), ("c0", "tree")]


def frames(spark, queries):
    return spark.createDataFrame(queries, "query_id string, query string"), spark.createDataFrame([(c, n, "PROVIDES") for c, n in EDGES], "chunk_id string, concept string, edge_type string")


def test_seed_scores_ride_along_the_path(spark):
    queries, edges = frames(spark, [("q", "an apple"), ("none", "zebra"), ("two", "apple owl")])
    seeds = {(r.query_id, r.concept): r.score for r in paths.scored_seeds(queries, edges).collect()}
    assert seeds[("q", "red apple")] > seeds[("q", "green apple pie")] > 0 and ("none", "tree") not in seeds
    got = [(r.chunk_id, round(r.score / seeds[("q", "red apple")], 6), r.length, r.path) for r in sorted(paths.evidence_paths(queries, edges, 9, max_hops=5).filter("query_id = 'q'").collect(), key=lambda r: r["rank"])]
    pie = round(seeds[("q", "green apple pie")] / seeds[("q", "red apple")], 6)
    assert got == [
        ("c1", 1.0, 1, ["red apple", "c1"]),
        ("c4", pie, 1, ["green apple pie", "c4"]),
        ("c2", 0.64, 3, ["red apple", "c1", "tree", "c2"]),
        ("c0", 0.64, 3, ["red apple", "c1", "tree", "c0"]),
        ("c3", 0.4096, 5, ["red apple", "c1", "tree", "c2", "old forest", "c3"]),
    ]
    assert [r.chunk_id for r in paths.scored_graph_top_k(queries, edges, 1, max_hops=1).filter("query_id = 'q'").collect()] == ["c1"]
    assert paths.evidence_paths(queries.limit(0), edges, 3).collect() == []


def test_a_concept_of_very_many_chunks_costs_its_neighbours_number(spark):
    edges = spark.range(5000).selectExpr("concat('c', id) AS chunk_id", "'hub' AS concept").unionAll(spark.range(5000).selectExpr("concat('c', id)", "if(id % 2 = 0, 'left', 'right')"))
    assert sorted((r.concept, r.beside) for r in paths.beside(edges).collect()) == [("hub", "left"), ("hub", "right"), ("left", "hub"), ("right", "hub")]
    queries = spark.createDataFrame([("q", "left")], "query_id string, query string")
    assert paths.best_paths(queries, edges, max_hops=3).count() == 2 and paths.evidence_paths(queries, edges, 4).count() == 4


def test_many_rules_say_what_few_do(spark, monkeypatch):
    from veriframe.operators import concepts
    from veriframe.plans.oracle import DATA_RULES

    rules = (*DATA_RULES, concepts.Rule(("b", "ab"), provides=("x", "y")), concepts.Rule(("a",), provides=("y",), depends_on=("z",)), concepts.Rule(("c",), provides=("last",), only_without_others=True))
    texts = ["ab thlynd", "C only", "eaea", None, "", "b sten ñra", "HAED"]
    chunks = spark.createDataFrame([(str(k), t, [k]) for k, t in enumerate(texts)], "chunk_id string, text string, hits array<int>")
    want = concepts.extract_concepts(chunks, rules)
    monkeypatch.setattr(concepts, "NEEDLES_IN_PLAN", 0)
    got = concepts.extract_concepts(chunks, rules)
    assert got.columns == want.columns
    clean = lambda df: sorted((r.chunk_id, r.text, r.hits, r.provides or [], r.depends_on or []) for r in df.fillna("").collect())
    assert clean(got) == clean(want)


def test_violations_of_common_ids_and_without_a_product(spark):
    from veriframe.operators import ontology

    results = spark.createDataFrame([("q", "c1", 1, "Aspirin treats fever."), ("q", "c2", 2, "no such thing"), ("r", "c1", 1, "Aspirin treats fever."), ("r", "c3", 2, None)], "query_id string, chunk_id string, rank int, text string")
    asked = spark.createDataFrame([("t", "aspirin", "treats", "FEVER", "must_not_hold"), ("t", "Aspirin", "cures", "gout", "must_hold"), ("u", "", "x", "", "must_hold"), ("v", None, "x", "thing", "must_hold")], "assertion_id string, subject string, relation string, object string, polarity string")
    found = ontology.ontology_violations(results, asked)
    got = sorted((r.query_id, r.rank, r.assertion_id, r.chunk_id, r.violation_type) for r in found.collect())
    assert got == [("q", 1, "t", "c1", "contradiction"), ("q", 2, "t", "c1", "candidate_violation"), ("q", 3, "v", "c2", "candidate_violation"), ("r", 1, "t", "c1", "contradiction"), ("r", 2, "t", "c1", "candidate_violation")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
