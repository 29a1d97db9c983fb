"""Approximate nearest neighbours by cosine: inverted lists under a coarse quantiser, residual product codes, exact re-ranking.

The quantisers are fitted on a bounded sample; every vector is in a list. Lists are folders, so that a search reads none but those it probes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriframe.functions.vectors import cosine
from veriframe.operators.joins import broadcast_if_small
from veriframe.operators.retrieval import top_k
from veriframe.sources.shared import cut
from veriframe.sources.versions import Folders

#: Vectors that the quantisers are fitted on, at most; a sample by hash of the whole table.
SAMPLE = 20_000
#: Lists: this many times the root of the number of vectors, within bounds.
LISTS_PER_ROOT, MOST_LISTS = 2, 4096
#: Components of a residual that one code byte stands for, and the iterations of fitting.
SUBSPACE, ITERATIONS = 2, 12
#: A search probes as many lists as hold this share of the PLACES best neighbours of TRIED sampled vectors within the sample.
SHARE, PLACES, TRIED = 0.96, 10, 400
#: Candidates for every result that are ranked exactly.
CANDIDATES = 8
#: Queries that are searched for at once.
BLOCK_QUERIES = 5000
#: Pairs of code and query that are in memory at once, and those that a task keeps before it drops all but the best.
BLOCK_PAIRS, KEPT_PAIRS = 1 << 22, 1 << 20
#: Codes that a task looks at, about; it passes on a query's best once for all of them.
TASK_CODES = 1 << 15


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one."""
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of every row, by Euclidean distance."""
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[k : k + 4096] @ centres.T - half, axis=1) for k in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, iterations: int = ITERATIONS) -> np.ndarray:
    """At most ``k`` centres of the rows of ``x``; an empty one is placed anew on a row drawn at random."""
    x = x.astype(np.float64)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(iterations):
        own = nearest(x, centres)
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], x[rng.integers(0, len(x), len(centres))])
    return centres


def ranked_lists(asked: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Per unit vector all lists, those of the nearest centres first."""
    return np.argsort((centres * centres).sum(axis=1) / 2 - asked @ centres.T, axis=1, kind="stable")


class Quantisers:
    """The coarse centres, for each subspace of the residuals up to 256 codewords, and how many lists a search should probe."""

    def __init__(self, centres: np.ndarray, words: list[np.ndarray], probes: int):
        self.centres, self.words, self.probes = centres, words, probes
        self.size = centres.shape[1]

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, seed: int = 1) -> "Quantisers":
        rng = np.random.default_rng(seed)
        x = unit(sample)
        centres = kmeans(x, lists, rng)
        own = nearest(x, centres)
        rest = x - centres[own]
        words = [kmeans(rest[:, k : k + SUBSPACE], 256, rng) for k in range(0, x.shape[1], SUBSPACE)]
        return cls(centres, words, cls._needed(x, own, centres, rng))

    @staticmethod
    def _needed(x: np.ndarray, own: np.ndarray, centres: np.ndarray, rng: np.random.Generator) -> int:
        """The number of lists by which the nearest neighbours within the sample have been met."""
        tried = x[rng.choice(len(x), min(TRIED, len(x)), replace=False)]
        best = np.argsort(-(tried @ x.T), axis=1)[:, :PLACES]
        place = np.empty((len(tried), len(centres)), int)
        np.put_along_axis(place, ranked_lists(tried, centres), np.arange(len(centres))[None], axis=1)
        met = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
        return int(met[int(np.ceil(SHARE * len(met))) - 1]) + 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, codes) of unit vectors."""
        own = nearest(x, self.centres)
        rest = x - self.centres[own]
        codes = [nearest(rest[:, k * SUBSPACE : (k + 1) * SUBSPACE], w).astype(np.uint8) for k, w in enumerate(self.words)]
        return own, np.stack(codes, axis=1)

    def decode(self, of: int, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes of one list stand for."""
        return self.centres[of] + np.concatenate([w[codes[:, k]] for k, w in enumerate(self.words)], axis=1)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.centres.tolist(), [w.tolist() for w in self.words], self.probes)], "centres array<array<double>>, words array<array<array<double>>>, probes int")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "Quantisers":
        row = spark.read.parquet(path).first()
        return cls(np.array(row["centres"]), [np.array(w) for w in row["words"]], row["probes"])


def _whole(vectors: DataFrame, id_col: str, vector_col: str, size: int | None = None) -> DataFrame:
    """(id, v): vectors with a length that isn't zero, without null or non-finite components, of ``size`` components if given."""
    v = vectors[vector_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].alias("id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    return rows if size is None else rows.filter(F.size("v") == size)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class _Best:
    """A task's ``most`` best codes of every query, by likeness and then id; memory is bounded however many come."""

    def __init__(self, queries: int, most: int):
        self.most, self.least = most, np.full(queries, -np.inf)
        self.parts: list[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, queries: np.ndarray, likeness: np.ndarray, ids: pa.Array, of: int) -> None:
        """The products (query, code) of some queries with codes of one list."""
        bound = self.least[queries]
        many = np.flatnonzero((likeness > bound[:, None]).sum(axis=1) > self.most)
        if len(many):
            bound[many] = np.partition(likeness[many], -self.most, axis=1)[:, -self.most]
        # equal vectors' products may differ by rounding
        row, code = np.nonzero(likeness >= bound[:, None] - 2e-9)
        if len(row):
            self.parts.append((queries[row].astype(np.int32), ids.take(pa.array(code)), np.full(len(row), of, np.int32), np.round(likeness[row, code], 9)))
            self.held += len(row)
            if self.held > KEPT_PAIRS:
                self._drop()

    def _drop(self) -> None:
        """Keep the best only."""
        q, ids, of, near = (pa.concat_arrays(p) if isinstance(p[0], pa.Array) else np.concatenate(p) for p in zip(*self.parts))
        place = np.empty(len(q), np.int64)
        place[pc.sort_indices(ids).to_numpy()] = np.arange(len(q))
        order = np.lexsort((-place, -near, q))
        ordered = q[order]
        rank = np.arange(len(q)) - np.searchsorted(ordered, ordered)
        last = order[rank == self.most - 1]
        self.least[q[last]] = near[last]
        kept = order[rank < self.most]
        self.parts, self.held = [(q[kept], ids.take(pa.array(kept)), of[kept], near[kept])], 0

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._drop()
            q, ids, of, near = self.parts[0]
            whole = pa.RecordBatch.from_arrays([pa.array(q), ids, pa.array(of), pa.array(near)], ["q", "id", "list", "near"])
            for start in range(0, len(q), 1 << 16):
                yield whole.slice(start, 1 << 16)


class VectorIndex:
    """An index under ``path``: quantisers, and folders of lists, each with the vectors' codes and the vectors."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.folders = Folders(spark, self.path)

    def build(self, vectors: DataFrame, id_col: str = "chunk_id", vector_col: str = "embedding", lists: int | None = None, sample: int = SAMPLE, seed: int = 1) -> "VectorIndex":
        """Fit the quantisers on up to ``sample`` vectors of the most common length, then index all vectors of that length.

        Vectors without a direction (null, zero, non-finite) have no cosine and aren't indexed; nor are null ids.
        """
        rows = _whole(vectors, id_col, vector_col)
        sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
        if sizes is None:
            raise ValueError("no vector has a direction")
        count, rows = sizes["count"], rows.filter(F.size("v") == sizes["size"])
        share = min(1.0, 1.2 * sample / count)
        drawn = rows.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < share * (1 << 20)).limit(sample).select("v").collect()
        lists = lists or max(1, min(MOST_LISTS, LISTS_PER_ROOT * isqrt(count)))
        q = Quantisers.fit(np.array([r["v"] for r in drawn] or [rows.first()["v"]]), lists, seed)
        q.rows(self.spark).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/quantisers")
        self.__dict__.pop("quantisers", None)
        self.folders.name([])
        return self.add(vectors, id_col, vector_col)

    @cached_property
    def quantisers(self) -> Quantisers:
        return Quantisers.read(self.spark, f"{self.path}/quantisers")

    def add(self, vectors: DataFrame, id_col: str = "chunk_id", vector_col: str = "embedding") -> "VectorIndex":
        """Index further vectors under the quantisers that are there."""
        q = self.quantisers

        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                own, codes = q.encode(unit(_matrix(b.column(1)))) if b.num_rows else (np.empty(0, int), np.empty((0, len(q.words)), np.uint8))
                code = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.int32()), code, b.column(1)], ["id", "list", "code", "v"])

        rows = _whole(vectors, id_col, vector_col, q.size)
        kind = rows.schema["id"].dataType.simpleString()
        placed = cut(rows.mapInArrow(batches, f"id {kind}, list int, code binary, v array<double>"))
        folder = self.folders.new()
        # ranges of (list, id): a list that holds a large share of all vectors is written by several tasks
        dealt = placed.repartitionByRange("list", "id")
        dealt.select("id", "code", "list").write.partitionBy("list").parquet(f"{self.path}/{folder}/codes")
        dealt.select("id", F.col("v").cast("array<float>").alias("v"), "list").write.partitionBy("list").parquet(f"{self.path}/{folder}/vectors")
        self.folders.name([*self.folders.live(), folder])
        return self

    def _read(self, table: str, lists: list[int]) -> DataFrame:
        """The rows of some lists; other lists' folders aren't opened."""
        parts = [self.spark.read.parquet(p).filter(F.col("list").isin(lists)) for p in self.folders.paths(table)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, candidates: int = CANDIDATES) -> DataFrame:
        """(query_id, chunk_id, score, rank) of queries (query_id, embedding): the best ``k`` of the ``probes`` nearest lists (by default as many as the
        quantisers call for), by exact cosine.

        A block of queries at a time, a task multiplies the vectors that its lists' codes stand for with the queries that probe them, and passes on the best
        ``candidates`` x k a query, of all its lists; the best of all tasks are ranked by their vectors. Queries without a direction find nothing.
        """
        asked = cut(_whole(queries.select("query_id", "embedding"), "query_id", "embedding", self.quantisers.size))
        count, codes = asked.count(), sum(self.spark.read.parquet(p).count() for p in self.folders.paths("codes"))
        blocks = max(1, -(-count // BLOCK_QUERIES))
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-codes // TASK_CODES))
        found = [self._near(asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b), probes, k * candidates, tasks) for b in range(blocks)]
        best = found[0]
        for f in found[1:]:
            best = best.unionByName(f)
        lists = [r["list"] for r in best.select("list").distinct().collect()]  # at most MOST_LISTS
        wanted = broadcast_if_small(best.join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("asked")), "query_id"))
        exact = self._read("vectors", lists).withColumn("list", F.col("list").cast("int")).join(wanted, ["list", "id"])
        scored = exact.select("query_id", F.col("id").alias("chunk_id"), cosine(F.col("asked"), F.col("v")).alias("score"))
        return top_k(scored, k)

    def _near(self, asked: DataFrame, probes: int | None, most: int, tasks: int) -> DataFrame:
        """(query_id, id, list): the ``most`` best of a block of queries by their codes."""
        rows = asked.orderBy("id").collect()  # about BLOCK_QUERIES
        q = self.quantisers
        vectors = unit(np.array([r["v"] for r in rows], float).reshape(len(rows), q.size))
        probed = ranked_lists(vectors, q.centres)[:, : probes or q.probes]
        # the queries of every list
        order = np.argsort(probed, axis=None, kind="stable")
        lists, first = np.unique(probed.ravel()[order], return_index=True)
        own = dict(zip(lists.tolist(), np.split((order // max(1, probed.shape[1])).astype(np.int32), first[1:])))
        shared = self.spark.sparkContext.broadcast((vectors, own))
        codes = self._read("codes", sorted(own)).select("id", F.col("list").cast("int").alias("list"), "code").coalesce(tasks)
        kind = codes.schema["id"].dataType.simpleString()

        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, of = shared.value
            best = _Best(len(x), most)
            for b in it:
                ids, placed = b.column(0), b.column(1).to_numpy()
                coded = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                for c in np.unique(placed):
                    mine = np.flatnonzero(placed == c)
                    there = q.decode(int(c), coded[mine])
                    for part in np.array_split(of[int(c)], -(-len(of[int(c)]) * len(mine) // BLOCK_PAIRS)):
                        best.add(part, x[part] @ there.T, ids.take(pa.array(mine)), int(c))
            yield from best.batches()

        near = codes.mapInArrow(batches, f"q int, id {kind}, list int, near double")
        order = Window.partitionBy("q").orderBy(F.desc("near"), F.desc("id"))
        kept = cut(near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).drop("n", "near"))
        named = self.spark.createDataFrame([(n, r["id"]) for n, r in enumerate(rows)], f"q int, query_id {asked.schema['id'].dataType.simpleString()}")
        return kept.join(F.broadcast(named), "q").drop("q")

    def scanned(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """(query_id, scanned, vectors): of how many vectors each query looks at the codes, and how many there are."""
        q = self.quantisers
        rows = _whole(queries.select("query_id", "embedding"), "query_id", "embedding", q.size)

        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                lists = ranked_lists(unit(_matrix(b.column(1))), q.centres)[:, : probes or q.probes]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(lists.astype(np.int32)), pa.list_(pa.int32()))], ["query_id", "lists"])

        kind = rows.schema["id"].dataType.simpleString()
        probed = rows.mapInArrow(batches, f"query_id {kind}, lists array<int>").select("query_id", F.explode("lists").alias("list"))
        sizes = cut(self.folders.read("codes").groupBy("list").agg(F.count("*").alias("n")))  # at most MOST_LISTS rows
        total = sizes.agg(F.sum("n")).first()[0]
        return probed.join(F.broadcast(sizes), "list", "left").groupBy("query_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scanned")).withColumn("vectors", F.lit(total).cast("long"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, hits, wanted): how many of each query's exact results ``found`` has."""
    both = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return both.groupBy("query_id").agg(F.count("hit").alias("hits"), F.count("*").alias("wanted"))
