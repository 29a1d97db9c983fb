"""Centroid clustering by sort-means: integer k-means whose assignment skips centroids that cannot be nearest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import cut, map_batches

CLUSTERS, ROUNDS, SIZE, SCALE, SEED = 16, 3, 64, 64, 1
#: Components lie within this after scaling, so that squared distances of vectors of SIZE components fit in a long.
MOST = 1 << 27


def integral(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors of exactly ``size`` components, none null or non-finite, each component x as the integer floor(scale * x).

    Others are left out. A component beyond MOST is an error: its squared distances need not fit in a long.
    """
    x = vectors[vector_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].alias("vec_id"), x.alias("x"))
    whole = (F.size("x") == size) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    far = F.exists("x", lambda c: F.abs(c) * scale > MOST)
    checked = F.when(far, F.raise_error(F.lit(f"a component is beyond {MOST} / {scale}")).cast("array<int>")).otherwise(F.transform("x", lambda c: F.floor(c * scale).cast("int")))
    return rows.filter(whole).select("vec_id", checked.alias("v"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The ``clusters`` vectors (fewer if there are fewer) whose ``<seed>:<vec_id>`` has the smallest SHA-256, in that order.

    Ties, as repeated ids make them, are ordered by components; null ids come last.
    """
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(hashed.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(clusters).collect()
    return np.array([r["v"] for r in rows], np.int64)


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = x - centroid
    return np.einsum("ij,ij->i", d, d)


class Assigner:
    """Nearest centroids of batches of vectors; the centroids are few and stay in memory."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.apart = np.array([squared(centroids, c) for c in centroids])
        self.order = np.argsort(self.apart, axis=1, kind="stable")

    def nearest(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of every vector, equal distances going to the smaller number.

        From the centroid of the assignment ``before``, at distance d, the others are tried by their distance from it. Once that is beyond
        2 d, strictly, no further one can be as near as d; in squares, beyond 4 d².
        """
        cluster, best = before.copy(), squared(x, self.centroids[before])
        reach = 4 * best
        for i in np.unique(before):
            left = np.flatnonzero(before == i)
            for j in self.order[i]:
                left = left[self.apart[i, j] <= reach[left]]
                if not len(left):
                    break
                if j == i:
                    continue
                d = squared(x[left], self.centroids[j])
                won = (d < best[left]) | (d == best[left]) & (j < cluster[left])
                cluster[left[won]], best[left[won]] = j, d[won]
        return cluster, best


def _assigned(x: np.ndarray, history: list[Assigner]) -> tuple[np.ndarray, np.ndarray]:
    """The assignment under the last centroids, each round's scan starting from the assignment of the round before."""
    cluster, best = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for a in history:
        cluster, best = a.nearest(x, cluster)
    return cluster, best


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _sums(vectors: DataFrame, history: list[np.ndarray]) -> dict[int, tuple[int, list[int]]]:
    """Per non-empty cluster its count and exact component sums; a batch passes on one row a cluster."""
    size = history[0].shape[1]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds = [Assigner(c) for c in history]
        for b in it:
            x = _matrix(b.column(0))
            cluster, _ = _assigned(x, rounds)
            numbers, n = np.unique(cluster, return_counts=True)
            sums = [x[cluster == k].sum(axis=0) for k in numbers]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(n, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = map_batches(vectors.select("v"), batches, "cluster int, n long, sums array<long>")
    exact = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(size)]
    return {r["cluster"]: (int(r["n"]), [int(r[f"s{k}"]) for k in range(size)]) for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect()}


def fit(vectors: DataFrame, start: np.ndarray, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The centroids of every round, ``start`` first. Each round moves non-empty ones to the floor of their vectors' exact mean; empty ones stay.

    Every round is one pass over the vectors that writes nothing: a task finds the assignments of the rounds before again, each from the one before
    it, which costs less than storing every vector's. The driver sees the clusters' sums only.
    """
    history = [start]
    for _ in range(rounds):
        moved = history[-1].copy()
        for k, (n, sums) in _sums(vectors, history).items():
            moved[k] = [s // n for s in sums]
        history.append(moved)
    return history


def assign(vectors: DataFrame, history: list[np.ndarray]) -> DataFrame:
    """(vec_id, cluster, distance) under the last centroids of ``history``; distance is squared."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds = [Assigner(c) for c in history]
        for b in it:
            cluster, best = _assigned(_matrix(b.column(1)), rounds)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster, pa.int32()), pa.array(best, pa.int64())], ["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return map_batches(vectors.select("vec_id", "v"), batches, f"vec_id {kind}, cluster int, distance long")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def centroid_clusters(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row per vector kept: (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256).

    Vectors that aren't whole (``integral``) give no row. Centroids are few and travel with the tasks; a hot vector costs no more than any
    other, since tasks pass on sums only. Fewer vectors than ``clusters`` are all centroids; equal ones leave the larger numbers empty. Repeated
    rows each give theirs, null ids are kept, an empty table gives an empty result. Extra columns are not read.
    """
    whole = integral(vectors, id_col, vector_col, size, scale)
    start = first_centroids(whole, clusters, seed)
    if not len(start):
        return assign(whole.limit(0), [np.zeros((1, size), np.int64)]).select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    history = fit(whole, start, rounds)
    placed = cut(assign(whole, history))
    inertia = {r["cluster"]: r["d"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    told = [(inertia.get(k, 0), digest(c)) for k, c in enumerate(history[-1])]
    at = F.col("cluster") + 1
    return placed.select(
        "vec_id",
        "cluster",
        "distance",
        F.element_at(F.lit([d for d, _ in told]).cast("array<bigint>"), at).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        F.element_at(F.lit([h for _, h in told]), at).alias("centroid_sha256"),
    )


def _oracle() -> str:
    """The same in DuckDB SQL: every round meets all centroids."""
    steps = [
        f"""v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE})""",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v) - 1 AS INTEGER) AS cluster, v AS c FROM v QUALIFY cluster < {CLUSTERS})",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS (SELECT r, vec_id, v, cluster, list_sum(list_transform(range(1, {SIZE + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS d FROM v, c{k}
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, cluster) = 1)""")
        if k < ROUNDS:
            steps.append(f"""s{k} AS (SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{k}, range(1, {SIZE + 1}) t(i) GROUP BY ALL)""")
            steps.append(f"""c{k + 1} AS (SELECT cluster, coalesce(m, c) AS c FROM c{k} LEFT JOIN (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM s{k} GROUP BY cluster) USING (cluster))""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (cluster)"""


ORACLE_SQL = _oracle()
