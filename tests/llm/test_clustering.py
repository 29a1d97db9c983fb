import hashlib
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from veriframe.llm import clustering as c

SIZE = 4


def brute(rows, k, rounds, size=SIZE, scale=64):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [v for _, v in order[:k]]

    def place():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        at = place()
        for j in range(len(cents)):
            own = [v for (_, v), (_, p) in zip(kept, at) if p == j]
            if own:
                cents[j] = [sum(x) // len(own) for x in zip(*own)]
    at = place()
    inertia = {j: sum(d for d, p in at if p == j) for j in range(len(cents))}
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in cents]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for (i, _), (d, j) in zip(kept, at)), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, i, "v") for i, v in rows], "vec_id long, embedding array<float>, cluster long, v string")


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def some(n, seed, grid=None):
    rng = random.Random(seed)
    draw = (lambda: rng.choice(grid)) if grid else (lambda: rng.gauss(0, 1))
    return [(i, [draw() for _ in range(SIZE)]) for i in range(n)]


@pytest.mark.parametrize("n,k,rounds,grid", [(400, 16, 3, None), (300, 7, 5, [0.0, 0.5, -0.5]), (60, 16, 0, [1.0, -1.0]), (5, 16, 3, None), (1, 16, 3, None)])
def test_against_brute_force(spark, n, k, rounds, grid):
    rows = some(n, n, grid)  # on a grid there are many ties and repeated vectors
    assert result(c.centroid_clusters(frame(spark, rows), k, rounds, size=SIZE)) == brute(rows, k, rounds)


def test_vectors_that_are_not_whole_and_repeated_rows(spark):
    rows = some(40, 1) + [(100, None), (101, []), (102, [1.0, 2.0, 3.0]), (103, [1.0, None, 2.0, 3.0]), (104, [float("nan")] * 4), (105, [1.0, 2.0, float("inf"), 0.0]), (106, [0.0] * 5)]
    rows += [(None, [0.1, 0.2, 0.3, 0.4])] * 2 + [(3, [9.0, -9.0, 9.0, 9.0])] * 5
    got = result(c.centroid_clusters(frame(spark, rows), 6, 3, size=SIZE))
    assert got == brute(rows, 6, 3) and len(got) == 47
    assert c.centroid_clusters(frame(spark, rows).limit(0), 6, 3, size=SIZE).collect() == []
    assert c.centroid_clusters(frame(spark, [(1, None)]), 6, 3, size=SIZE).collect() == []


def test_a_third_of_all_rows_are_one_vector(spark):
    rows = some(200, 5) + [(1000 + k, [0.25, 0.5, 0.75, 1.0]) for k in range(100)]
    assert result(c.centroid_clusters(frame(spark, rows), 8, 3, size=SIZE)) == brute(rows, 8, 3)


def test_scan_skips_only_what_cannot_be_nearest():
    rng = np.random.default_rng(3)
    for _ in range(50):
        cents, x = rng.integers(-3, 4, (12, 3)), rng.integers(-4, 5, (300, 3))
        d = ((x[:, None] - cents[None]) ** 2).sum(axis=2)
        cluster, best = c.Assigner(cents).nearest(x, rng.integers(0, 12, 300))
        assert (cluster == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        c.centroid_clusters(frame(spark, [(1, [1e9, 0.0, 0.0, 0.0])]), size=SIZE)
    assert result(c.centroid_clusters(frame(spark, [(1, [2e6, -2e6, 2e6, 2e6]), (2, [-2e6, 2e6, -2e6, -2e6])]), 1, 0, size=SIZE))[0][2] in (0, 4 * 256_000_000**2)


def test_oracle(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    got = c.centroid_clusters(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))
    want = con.execute(c.ORACLE_SQL)
    assert [d[0] for d in want.description] == got.columns and result(got) == sorted(want.fetchall(), key=repr)
    rows = [(k, [float(x) for x in np.random.default_rng(k // 2).normal(size=64).round(1)]) for k in range(40)] + [(3, None), (4, [1.0]), (None, [0.5] * 64), (50, [float("nan")] * 64)]
    con.register("tmp_vectors", pa.table({"vec_id": [i for i, _ in rows], "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32()))}))
    con.execute("CREATE OR REPLACE VIEW embeddings AS SELECT * FROM tmp_vectors")
    assert result(c.centroid_clusters(frame(spark, rows))) == sorted(con.execute(c.ORACLE_SQL).fetchall(), key=repr)
