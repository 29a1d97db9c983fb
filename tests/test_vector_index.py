"""The vector index against exact search: recall, lists, odd vectors."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from veriframe.functions.vectors import cosine
from veriframe.operators import retrieval
from veriframe.operators import vector_index as vi
from veriframe.operators.retrieval import vector_top_k
from veriframe.plans import registry


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, embedding array<float>")


def asked(vectors, every=1):
    return vectors.filter(F.col("chunk_id") % every == 0).withColumnRenamed("chunk_id", "query_id")


def result(df):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 6)) for r in df.collect())


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 3
    x = np.concatenate([c + rng.normal(size=(40, 16)) for c in centres])
    return frame(spark, [(k, v.tolist()) for k, v in enumerate(x)])


def test_recall_and_scan_share_on_clusters(spark, clustered, tmp_path):
    index = vi.VectorIndex(spark, str(tmp_path)).build(clustered)
    q = asked(clustered, 7)
    told = vi.recall(index.search(q, 10), vector_top_k(q, clustered, 10)).collect()
    assert len(told) == 229 and sum(r.hits for r in told) >= 0.95 * sum(r.wanted for r in told)
    seen = index.scanned(q).collect()
    assert {r.vectors for r in seen} == {1600} and np.mean([r.scanned for r in seen]) < 0.35 * 1600


def test_all_lists_give_the_exact_result(spark, clustered, tmp_path):
    index = vi.VectorIndex(spark, str(tmp_path)).build(clustered, lists=20)
    q = asked(clustered, 50)
    assert result(index.search(q, 5, probes=20, candidates=20)) == result(vector_top_k(q, clustered, 5))


def test_blocks_of_queries_say_the_same(spark, clustered, tmp_path, monkeypatch):
    index = vi.VectorIndex(spark, str(tmp_path)).build(clustered, lists=20)
    q = asked(clustered, 40)
    whole = result(index.search(q, 5))
    monkeypatch.setattr(vi, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(vi, "BLOCK_PAIRS", 50)
    assert result(index.search(q, 5)) == whole


def test_added_vectors_are_found(spark, clustered, tmp_path):
    index = vi.VectorIndex(spark, str(tmp_path)).build(clustered.filter("chunk_id < 1200"), lists=10)
    index.add(clustered.filter("chunk_id >= 1200"))
    q = asked(clustered, 60)
    assert result(vi.VectorIndex(spark, str(tmp_path)).search(q, 5, probes=10, candidates=20)) == result(vector_top_k(q, clustered, 5))


def test_only_probed_lists_are_read(spark, clustered, tmp_path):
    index = vi.VectorIndex(spark, str(tmp_path)).build(clustered, lists=20)
    plan = index._read("codes", [3, 4])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "list#" in plan.split("PartitionFilters")[1][:80]
    assert {r.list for r in index._read("codes", [3, 4]).select("list").distinct().collect()} == {3, 4}


def test_odd_vectors_and_a_hot_one(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(60)] + [(100 + k, [1.0, 0.0, 0.0, 0.0]) for k in range(40)]
    odd = [(200, None), (201, [0.0] * 4), (202, [1.0, None, 0.0, 0.0]), (203, [math.nan] * 4), (204, [math.inf, 1.0, 0.0, 0.0]), (205, [1.0, 2.0]), (None, [1.0] * 4)]
    vectors = frame(spark, rows + odd)
    index = vi.VectorIndex(spark, str(tmp_path)).build(vectors, lists=6)
    found = index.search(asked(vectors), 5, probes=6, candidates=30)
    good = frame(spark, rows)
    assert result(found) == result(vector_top_k(asked(good), good, 5))
    assert index.search(asked(vectors).limit(0), 5).collect() == []
    with pytest.raises(ValueError):
        vi.VectorIndex(spark, str(tmp_path / "none")).build(frame(spark, odd[:2]))


def test_registered_recall(spark):
    rows = registry.queries()["vector_index_recall"](spark, "/root/testdata/sf0.001").collect()
    assert sum(r.hits for r in rows) >= 0.9 * sum(r.wanted for r in rows) and all(0 < r.scanned <= r.vectors for r in rows)


def test_exact_search_multiplies_blocks(spark, monkeypatch):
    """Every pair is scored, over several blocks, with copies, ties and odd vectors, and no pair is a row of a join."""
    rng = np.random.default_rng(5)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(300, 8)))]
    rows += [(300 + k, rows[3][1]) for k in range(50)] + [(400 + k, (2 * rng.normal(size=5)).tolist()) for k in range(9)]
    rows += [(500, None), (501, [0.0] * 8), (502, [1.0, None] + [0.0] * 6), (503, [1e-200] * 8), (504, [1e200] + [0.0] * 7), (505, [float("nan")] * 8), (506, [])]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    queries = vectors.filter("chunk_id % 7 = 3 OR chunk_id >= 500").withColumnRenamed("chunk_id", "query_id")
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 20)
    monkeypatch.setattr(retrieval, "BLOCK_VECTORS", 70)
    pairs = queries.withColumnRenamed("embedding", "asked").crossJoin(vectors).select("query_id", "chunk_id", cosine(F.col("asked"), F.col("embedding")).alias("score"))
    want = retrieval.top_k(pairs.filter(F.col("score").isNotNull()), 4)
    columns = ["query_id", "chunk_id", "rank", F.col("score").cast("string")]
    assert sorted(map(tuple, vector_top_k(queries, vectors, 4).select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    plain = vector_top_k(queries.filter("query_id < 500"), vectors.filter("chunk_id < 500"), 4)
    assert "NestedLoop" not in plain._jdf.queryExecution().toString()


def test_a_task_passes_on_a_querys_best_once(monkeypatch):
    """However many lists a task holds, it gives out ``most`` codes a query, and of ties those of the greatest ids."""
    monkeypatch.setattr(vi, "KEPT_PAIRS", 200)
    rng = np.random.default_rng(3)
    best, pairs = vi._Best(9, 5), []
    for c in range(30):
        queries, ids = np.sort(rng.choice(9, 6, replace=False)), rng.permutation(20) + 20 * c
        likeness = np.round(rng.normal(size=(6, 20)), 1)
        pairs += [(q, -s, -i, c) for q, row in zip(queries.tolist(), likeness.tolist()) for s, i in zip(row, ids.tolist())]
        best.add(queries, likeness + rng.normal(size=likeness.shape) * 1e-15, pa.array(ids), c)
    got = [r for b in best.batches() for r in zip(*(col.to_pylist() for col in b.columns))]
    want = [p for q in range(9) for p in sorted(p for p in pairs if p[0] == q)[:5]]
    assert sorted(got) == sorted((q, -i, c, -s) for q, s, i, c in want)


def test_codes_stand_for_vectors():
    """The products that a search ranks by are those of subspaces and codewords."""
    rng = np.random.default_rng(8)
    x = vi.unit(rng.normal(size=(300, 6)))
    q = vi.Quantisers.fit(x, 4)
    own, codes = q.encode(x)
    mine = own == own[0]
    summed = x @ q.centres[own[0]] + 0
    near = np.stack([summed + sum(x[:, 2 * k : 2 * k + 2] @ w[c[k]] for k, w in enumerate(q.words)) for c in codes[mine]], axis=1)
    assert np.allclose(x @ q.decode(int(own[0]), codes[mine]).T, near)
