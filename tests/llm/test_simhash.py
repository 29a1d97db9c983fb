import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veriframe.llm import common, simhash


def brute(texts):
    def mark(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))

    ids = list(texts)
    fp = {i: mark(texts[i]) for i in ids}
    root = {i: i for i in ids}
    for _ in ids:
        for i in ids:
            for j in ids:
                if (fp[i] ^ fp[j]).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    return {(i, f"{fp[i]:016x}", root[i]) for i in ids}


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = ["Alpha", "beta", "gämma", "delta", "eps", "zeta", "eta", "THETA", "iota"]
    texts = {i: " ".join(rng.choices(words, k=rng.randint(0, 40))) for i in range(0, 60)}
    for i in range(60, 90):
        base = texts[rng.randrange(60)].split()
        if base:
            base[rng.randrange(len(base))] = "changed"
        texts[i] = "\n".join(base)
    texts |= {90: None, 91: "", 92: "one", 93: "one two", 94: "x" * 50000, 95: " \t "}
    rows = [(i, t, "text") for i, t in texts.items()]
    got = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string, fp string"))
    assert {tuple(r) for r in got.collect()} == brute(texts)
    assert got.count() == len(texts)


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(2, "a b c"), (2, "a b c"), (1, "A  B C")], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_dedup(df).collect()] == [1, 1, 1]
    assert simhash.near_dedup(df.limit(0)).collect() == []


def test_blocks_meet_every_near_pair_and_the_tally_rejects():
    assert len(simhash.BLOCKS) == 14 and len({frozenset(c) for c in simhash.FIVES}) == 56
    for differ in combinations(range(8), 3):
        assert sum(not set(c) & set(differ) for c in simhash.BLOCKS) == 1
    rng = np.random.default_rng(3)
    block = simhash.BLOCKS[5]
    base = rng.integers(0, 2**64, 1, dtype=np.uint64)
    values = (base & simhash.MASKS[5]) | (rng.integers(0, 2**64, 4000, dtype=np.uint64) & ~simhash.MASKS[5])
    x = values ^ base
    shared = simhash.tally(x)
    assert (shared >= 4).all() and (shared == 4).sum() > 3000 and (shared >= 5).sum() > 10  # candidates of the list, those retained
    assert not simhash.near(np.repeat(base, 4000), values)[shared == 4].any()
    four = base ^ np.uint64(sum(1 << 8 * (7 - p) for p in range(8) if p not in block))
    assert np.bitwise_count(four ^ base) == 4 and simhash.tally(four ^ base) == 4


def test_the_count_decides_before_verification(monkeypatch):
    """Every retained pair was counted: raising the guaranteed minimum loses pairs that differ in three bytes."""
    a = np.array([0], np.uint64)
    b = np.array([1 | 1 << 8 | 1 << 16], np.uint64)
    assert simhash.near(a, b).all()
    monkeypatch.setattr(simhash, "SHARED", 6)
    assert not simhash.near(a, b).any()


@pytest.mark.parametrize("n", [20, 300, 3000])
def test_links_of_dense_groups(n):
    rng = np.random.default_rng(n)
    free = np.arange(16, 48).astype(np.uint64)
    values = np.zeros(n, np.uint64)
    for p in free[: 12 if n > 1000 else 32]:
        values |= rng.integers(0, 2, n).astype(np.uint64) << p
    values = np.unique(values)
    keep = [v for k, v in enumerate(values) if k % 3]
    values = np.array(keep)
    bits = np.bitwise_count(values[:, None] ^ values[None, :])
    i, j = np.nonzero(bits <= 3)
    shared = [(k, m) for k, m in zip(i, j) if sum(int(values[k] ^ values[m]) >> 8 * b & 255 == 0 for b in range(8)) >= 5]
    want = simhash.forest(len(values), np.array([x for x, _ in shared]), np.array([y for _, y in shared]))
    assert np.array_equal(simhash.forest(len(values), np.arange(len(values)), simhash.near_links(values)), want)


@pytest.mark.parametrize("most", [simhash.LIST_VALUES, 3])
def test_every_close_pair_is_linked(spark, most):
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(200)]
    fps += [f ^ sum(1 << p for p in rng.sample(range(64), rng.randint(1, 5))) for f in fps]
    fps += [fps[0] ^ sum(1 << p for p in rng.sample(range(64), rng.randint(1, 3))) for _ in range(200)]
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in set(fps)]
    got = simhash.components(simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), most))
    pairs = {(a % (1 << 64), b % (1 << 64)) for a, b in got.filter(F.col("node") != F.col("root")).collect()}
    root = {f: f for f in fps}
    close = [(a, b) for a in root for b in root if a < b and (a ^ b).bit_count() <= 3]
    seen = {x for p in pairs for x in p}
    assert seen == {x for p in close for x in p}


def test_hot_fingerprints_null_ids_and_clashing_names(spark):
    df = spark.range(2000).selectExpr("if(id % 2 = 0, id, NULL) AS doc_id", "concat('same words of a text ', if(id % 3 = 0, '', NULL)) AS text", "id AS __id", "id AS fp", "id AS component_id")
    got = simhash.near_dedup(df)
    assert got.count() == 2000 and {tuple(r) for r in got.select("fingerprint", "component_id").distinct().collect()} == {(f, i) for _, f, i in brute({0: "same words of a text", 2: None})}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and kept.filter("doc_id IS NULL").count() == 1000
    assert sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()) == [0, 2]


def test_components_with_a_hot_node(spark):
    star = [(0, k) for k in range(1, 1500)] + [(1499, 2000), (2000, 2001), (5000, 5001), (7, 7)]
    edges = spark.createDataFrame(star, "a long, b long")
    want = {(k, 0) for k in [*range(1500), 2000, 2001]} | {(5000, 5000), (5001, 5000)}
    assert {tuple(r) for r in simhash.components(edges).collect()} == want


def test_adaptive_execution_splits_a_hot_node(spark):
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in small}
    plans = []
    keep, common.cut = common.cut, lambda d: (plans.append(d), keep(d))[1]
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        edges = spark.range(20000, numPartitions=8).selectExpr("if(id % 10 = 0, id, 1) AS a", "id + 20000 AS b")
        common.components(edges)
        join = next(d for d in plans if "Join" in d._jdf.queryExecution().toString())
        join.collect()
        assert "skew=true" in join._jdf.queryExecution().executedPlan().toString()
    finally:
        common.cut = keep
        for k, v in before.items():
            spark.conf.set(k, v)


def test_keep_one_judges_rows_and_not_ids(spark):
    a, b = "a text that nothing else is like at all", "quite another text about other matters, with a copy"
    df = spark.createDataFrame([(5, a, 1), (5, b, 2), (1, b, 3), (None, b, 4)], "doc_id long, text string, nth long")
    assert sorted(tuple(r) for r in simhash.keep_one(df).collect() if r.doc_id) == [(1, b, 3), (5, a, 1)]
    same = spark.createDataFrame([(5, a)] * 4 + [(5, b)] * 3, "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.keep_one(same).collect()) == [(5, a), (5, b)]
