"""Similarity join and canonical concepts against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from veriframe.operators import components as comp
from veriframe.operators import similar
from veriframe.operators.concepts import canonical_concepts


def groups(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(k) for k in range(n)]


def vectors(n, size=24, seed=1, spread=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, size))
    return np.array([centres[k % len(centres)] + spread * rng.normal(size=size) for k in range(n)])


def frame(spark, x):
    return spark.createDataFrame([(f"t{k:04d}", v.tolist()) for k, v in enumerate(x)], "term string, embedding array<double>")


@pytest.mark.parametrize("threshold", [0.9, 0.97])
def test_components_of_all_pairs(spark, threshold):
    x = vectors(600)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(unit @ unit.T > threshold, 1))
    got = similar.similar_links(frame(spark, x), threshold).collect()
    pairs = [(int(r.a[1:]), int(r.b[1:])) for r in got]
    assert len(pairs) < 20 * len(x)  # forests; an edge may stand for a chain of like ones
    assert groups(600, pairs) == groups(600, list(zip(i.tolist(), j.tolist()))) and len(i) > 100


def test_large_buckets_are_split_and_equal_vectors_are_not_compared(spark, monkeypatch):
    monkeypatch.setattr(similar, "BUCKET", 16)
    x = np.concatenate([vectors(300, spread=0.1), np.repeat(vectors(1 * 6, seed=9)[:1], 200, axis=0)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(unit @ unit.T > 0.9, 1))
    pairs = [(int(r.a[1:]), int(r.b[1:])) for r in similar.similar_links(frame(spark, x), 0.9).collect()]
    assert groups(500, pairs) == groups(500, list(zip(i.tolist(), j.tolist())))


def test_bands():
    for t in (0.99, 0.9, 0.7, 0.5):
        bands, bits = similar.bands_for(t)
        agree = 1 - np.arccos(t) / np.pi
        assert bands <= similar.MOST_BANDS and (1 - agree**bits) ** bands <= 1.1 * similar.MISS


def test_canonical_names_and_odd_vectors(spark):
    rows = [("Heart Failure", [1.0, 0.0]), ("heart  failure acute", [0.99, 0.05]), (" HF ", [0.98, 0.1]), ("kidney", [0.0, 1.0]), ("none", None), ("zero", [0.0, 0.0]), ("other size", [1.0, 0.0, 0.0]), ("kidney", [0.0, 1.0]), (None, [1.0, 0.0])]
    got = dict(map(tuple, canonical_concepts(spark.createDataFrame(rows, "term string, embedding array<double>")).collect()))
    assert got == {"Heart Failure": "hf", "heart  failure acute": "hf", " HF ": "hf", "kidney": "kidney", "none": "none", "zero": "zero", "other size": "other size"}
    assert canonical_concepts(spark.createDataFrame(rows, "term string, embedding array<double>").limit(0)).collect() == []


def test_rounds_are_logarithmic_on_a_chain(spark, monkeypatch):
    rounds = []
    real = comp._state
    monkeypatch.setattr(comp, "_state", lambda links: (rounds.append(1), real(links))[1])
    edges = spark.range(511).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = comp.components(edges).collect()
    assert {r.root for r in got} == {0} and len(got) == 512 and len(rounds) <= 14
    assert comp.components(edges.limit(0)).collect() == []


@pytest.mark.parametrize("block", [150, 32_768])
def test_low_thresholds_compare_all_pairs(spark, monkeypatch, block):
    """Nearly unclustered vectors: bands would put each into many large buckets, and parts of those miss links."""
    monkeypatch.setattr(similar, "BUCKET", 16)
    monkeypatch.setattr(similar, "BLOCK", block, raising=False)
    x = np.random.default_rng(4).normal(size=(500, 40))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(unit @ unit.T > 0.45, 1))
    both = frame(spark, x).unionByName(frame(spark, x[:3, :7]).withColumn("term", F.concat(F.lit("t07"), F.substring("term", 4, 2))))
    pairs = [(int(r.a[1:]), int(r.b[1:])) for r in similar.similar_links(both, 0.45).collect()]
    pairs = [(a, b) for a, b in pairs if a < 500]
    assert groups(500, pairs) == groups(500, list(zip(i.tolist(), j.tolist()))) and len(i) > 100
