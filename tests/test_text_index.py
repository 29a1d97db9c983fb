"""The stored index against the scans."""

import random

import pytest
from pyspark.sql import functions as F
from veriframe.functions.stemming import english_tokens
from veriframe.operators import retrieval, text_index
from veriframe.operators.chunking import tokenised
from veriframe.operators.text_index import TextIndex


def chunks_of(spark, n=900, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    rows = [(f"d-{k:05d}", " ".join(rng.choices(words, weights, k=rng.randint(0, 30)))) for k in range(n)]
    rows += [("e-1", ""), ("e-2", "W0 w0, w0!"), ("e-3", "w7 " * 500)]
    return spark.createDataFrame(rows, "chunk_id string, text string")


QUERIES = [("a", "w0 w1 w2"), ("b", "w399 w3"), ("c", "w17"), ("d", "nothing here"), ("e", ""), ("f", "w0"), ("g", "w0 w0 W7 w250 w251 w252"), ("h", "w5 unknown")]


@pytest.fixture(scope="module")
def chunks(spark):
    return chunks_of(spark)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id string, query string")


def rows(df):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in df.collect())


def scans(queries, chunks, k):
    terms = tokenised(chunks)
    return {"bm25": retrieval.bm25_top_k(queries, terms, k), "overlap": retrieval.lexical_top_k(queries, terms, k), "jaccard": retrieval.jaccard_top_k(queries, terms, k)}


@pytest.fixture(params=[3, 12])
def range_bits(request, monkeypatch):
    """Small ranges make many blocks."""
    monkeypatch.setattr(text_index, "RANGE_BITS", request.param)
    return request.param


def test_search_equals_scans(spark, chunks, queries, tmp_path, range_bits):
    index = TextIndex(spark, str(tmp_path)).add(chunks)
    for score, want in scans(queries, chunks, 5).items():
        assert rows(index.search(queries, 5, score)) == rows(want), score


def test_segments_and_merging(spark, chunks, queries, tmp_path):
    index = TextIndex(spark, str(tmp_path))
    assert not index.exists()
    for part in range(3):
        index.add(chunks.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(3)) == part))
    want = {k: rows(v) for k, v in scans(queries, chunks, 4).items()}
    assert len(index.folders.live()) == 3 and all(rows(index.search(queries, 4, k)) == v for k, v in want.items())
    index.add(spark.createDataFrame([("z-1", "w0 w1 w2")], "chunk_id string, text string"))
    index.merge(most_chunks=10)
    assert len(index.folders.live()) == 4  # a single small segment stays
    index.merge()
    more = chunks.unionByName(spark.createDataFrame([("z-1", "w0 w1 w2")], "chunk_id string, text string"))
    assert len(index.folders.live()) == 1 and {k: rows(index.search(queries, 4, k)) for k in want} == {k: rows(v) for k, v in scans(queries, more, 4).items()}
    assert index.terms().count() == more.count()
    index.clear()
    assert not index.exists()


def test_blocks_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "RANGE_BITS", 4)
    rare = [(f"c-{k:05d}", "common words here" + (" rare" if k in (777, 1205) else "")) for k in range(1600)]
    chunks = spark.createDataFrame(rare, "chunk_id string, text string")
    asked = spark.createDataFrame([("q", "common rare"), ("r", "common")], "query_id string, query string")
    index = TextIndex(spark, str(tmp_path)).add(chunks)
    assert rows(index.search(asked, 2)) == rows(retrieval.bm25_top_k(asked, tokenised(chunks), 2))
    told = {r.query_id: (r.blocks, r.read) for r in index.blocks_read(asked, 2).collect()}
    assert told["q"][0] >= 102 and told["q"][1] == 4 and told["r"][1] <= 3, told


def test_other_analysis_and_unknown_scores(spark, tmp_path):
    chunks = spark.createDataFrame([("1", "The running dogs"), ("2", "a dog runs")], "chunk_id string, text string")
    asked = spark.createDataFrame([("q", "dogs running")], "query_id string, query string")
    found = TextIndex(spark, str(tmp_path), english_tokens).add(chunks).search(asked, 5)
    assert {r.chunk_id for r in found.collect()} == {"1", "2"}
    with pytest.raises(ValueError):
        TextIndex(spark, str(tmp_path)).search(asked, 5, "tfidf")


def test_term_counts(spark):
    df = spark.createDataFrame([(["b", "a", "b", "b"],), ([],), (["x"],)], "t array<string>")
    assert [[tuple(x) for x in r.c or ()] for r in df.select(text_index.term_counts(F.col("t")).alias("c")).collect()] == [[("a", 1), ("b", 3)], [], [("x", 1)]]


def test_no_posting_is_shuffled(spark, chunks, queries, tmp_path, monkeypatch):
    """Blocks are made where ranges are read, also of ranges that lie in several batches."""
    docs = spark.createDataFrame([(k, ["a", "b", "a"] if k % 3 else None if k % 2 else []) for k in range(40)], "doc long, all array<string>").coalesce(1)
    made = text_index.postings(docs, 3)
    assert "Exchange hash" not in made._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = made.orderBy("token", "range").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    own = [k for k in range(8, 16) if k % 3]
    assert len(got) == 10 and tuple(got[1]) == ("a", 1, len(own), 2, 3, 2, [k - 8 for k in own], [2] * len(own), [3] * len(own), [2] * len(own))
