"""Standing results of a stream equal the batch plan over the newest versions, in any order and after restarts."""

import random

import pytest
from veriframe.plans.claims import with_defaults
from veriframe.streaming import standing
from veriframe.streaming.ingest import document_stream

SCHEMA = "document_id string, version long, text string"
VERSIONS = [
    ("a", 1, "Aspirin treats headache."),
    ("a", 2, "Aspirin does not treat much. It treats headache, they say."),
    ("a", 3, "Nothing of that."),
    ("b", 1, "Aspirin treats headache and fever."),
    ("b", 1, "Aspirin treats headache and fever."),
    ("c", 5, "New text first"),
    ("c", 4, "aspirin treats headache late"),
    ("d", 1, None),
    ("d", 2, ""),
    ("e", 7, "one text of version seven"),
    ("e", 7, "another text of version seven"),
    (None, 1, "no id"),
    ("f", None, "no version"),
]


@pytest.fixture(scope="module")
def claims(spark):
    rows = [("t0", "Aspirin", "treats", "headache", "must_hold"), ("t1", "aspirin", "treats", "fever", "must_not_hold"), ("t2", "water", "is", "wet", "must_hold"), ("t3", "", "is", "", "must_hold")]
    return with_defaults(spark.createDataFrame(rows, "assertion_id string, subject string, relation string, object string, polarity string"))


def numbers(df):
    return {(r.kind, r.key): r.n for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_batches_and_restarts(spark, tmp_path, claims, seed):
    rng = random.Random(seed)
    rows = VERSIONS[:]
    rng.shuffle(rows)
    want = numbers(standing.standing_of(spark.createDataFrame(rows, SCHEMA), claims))
    for part in (rows[:5], rows[5:9], rows[9:]):  # a run for each part: the state outlives the query
        spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = document_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, files_each=1)
        standing.keep_standing(stream, str(tmp_path / "out"), str(tmp_path / "state"), claims).awaitTermination(180)
    got = standing.standing(spark.read.parquet(str(tmp_path / "out")))
    assert numbers(got) == want
    assert want[("token", "headache")] == 1 and want[("supports", "t0")] == 1 and want[("refutes", "t1")] == 1 and ("token", "late") not in want and ("token", "id") not in want
    told = {r.assertion_id: (r.supports, r.refutes, r.label) for r in standing.verdicts(claims, got).collect()}
    assert told == {"t0": (1, 0, "supported"), "t1": (0, 1, "contradicted"), "t2": (0, 0, "unknown"), "t3": (0, 0, "unknown")}


def test_without_claims_the_tokens_are_document_frequencies(spark):
    from veriframe.operators.chunking import document_frequency, token_index

    docs = spark.createDataFrame([(k, 1, t) for k, t in (("1", "a b a"), ("2", "b c"), ("3", ""))], SCHEMA)
    index = token_index(docs.selectExpr("document_id AS chunk_id", "text"))
    assert {k[1]: n for k, n in numbers(standing.standing_of(docs)).items()} == {r.token: r.df for r in document_frequency(index).collect()} == {"a": 1, "b": 2, "c": 1}
