"""Similarity join of vectors by cosine: signed random projections in bands, exact checks inside buckets, links as forests; blocks of all pairs where bands don't pay."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import acos, ceil, log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.operators.products import tiles
from veriframe.sources.shared import cut

#: A pair exactly at the threshold is in no common bucket with at most this probability.
MISS = 1e-4
BITS, MOST_BANDS = 12, 64
#: Vectors of a bucket that are compared all with all; larger buckets are split by further bits, in SPLITS ways each.
BUCKET, SPLITS, LEVELS = 2048, 8, 4
SEED = 11
#: Bands are used where they compare less than one pair in this many; else all pairs are compared, in blocks of BLOCK vectors.
PAYS, BLOCK = 8, 65_536
#: Mixes further bits into a bucket's key.
_MIX = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float, bits: int = BITS, miss: float = MISS, most: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, bits): as many bits as ``most`` bands allow; a projection's sign agrees with probability 1 - angle / pi."""
    agree = 1 - acos(threshold) / pi
    while bits > 1 and log(miss) / log(1 - agree**bits) > most:
        bits -= 1
    return min(most, ceil(log(miss) / log(1 - agree**bits))), bits


def _bits(x: np.ndarray, bits: int, *name: int) -> np.ndarray:
    """``bits`` signs of every row's projections as one number; the directions depend on ``name`` alone."""
    directions = np.random.default_rng([SEED, *name]).normal(size=(x.shape[1], bits))
    return ((x @ directions > 0) @ (1 << np.arange(bits))).astype(np.uint64)


def _mixed(key: np.ndarray, more: np.ndarray) -> np.ndarray:
    out = (key ^ more) * _MIX
    return out ^ (out >> np.uint64(29))


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least vertex of each vertex's component in a graph of n vertices."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], least)
        np.minimum.at(root, root[j], least)
        root = root[root]
        if (root == before).all():
            return root


def _posted(level: int, bands: int, bits: int):
    """(key, term, v) from (key, term, v): a row for each band at first, for each way to split a bucket later."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sizes = np.array([len(x) // 8 for x in b.column(2).to_pylist()])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = np.frombuffer(b"".join(b.column(2).take(pa.array(at)).to_pylist()), np.float64).reshape(len(at), size)
                old = b.column(0).take(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                for k in range(SPLITS if level else bands):
                    key = _mixed(_mixed(old, np.full(len(at), size, np.uint64)), _bits(x, bits, level, k) + np.uint64(k << 32))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(1).take(pa.array(at)), b.column(2).take(pa.array(at))], ["key", "term", "v"])

    return batches


def _linked(threshold: float, last: bool):
    """From rows sorted by key: a spanning forest of each bucket's verified pairs as (a, b); rows of a bucket that is too large as (a, null, key, v).

    At the ``last`` level a bucket goes on in parts that share one vector; its vectors agree in so many signs that a part's are alike.
    """

    def links(terms: list[str], vectors: list[bytes]) -> tuple[list[str], list[str]]:
        x = np.frombuffer(b"".join(vectors), np.float64).reshape(len(terms), -1)
        i, j = np.nonzero(np.triu(x @ x.T > threshold, 1))
        root = _forest(len(terms), i, j)
        child = np.flatnonzero(root != np.arange(len(terms)))
        return [terms[k] for k in root[child]], [terms[k] for k in child]

    def batch(a: list, b: list, key: list, v: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(key, pa.int64()), pa.array(v, pa.binary())], ["a", "b", "key", "v"])

    def closed(key: int, terms: list[str], vectors: list[bytes], over: bool) -> Iterator[pa.RecordBatch]:
        if over and not last:
            yield batch(terms, [None] * len(terms), [key] * len(terms), vectors)
        for size in {len(v) for v in vectors} if len(terms) > 1 and (last or not over) else ():  # keys of different lengths hardly ever collide
            own = [k for k, v in enumerate(vectors) if len(v) == size]
            a, b = links([terms[k] for k in own], [vectors[k] for k in own])
            yield batch(a, b, [None] * len(a), [None] * len(a))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, terms, vectors, over = None, [], [], False
        for b in it:
            for k, t, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if k != key:
                    yield from closed(key, terms, vectors, over)
                    key, terms, vectors, over = k, [], [], False
                elif len(terms) >= BUCKET:
                    over = True
                    yield from closed(key, terms, vectors, True)
                    terms, vectors = (terms[-1:], vectors[-1:]) if last else ([], [])
                terms.append(t)
                vectors.append(v)
        yield from closed(key, terms, vectors, over)

    return batches


def _block_links(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """From the rows (part, term, v) of one block, or of two: a spanning forest, as (a, b), of the pairs in the one or between the two."""

    def links(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("term")
        part, terms = rows.column("part").to_numpy(), rows.column("term").combine_chunks()
        x = np.frombuffer(b"".join(rows.column("v").to_pylist()), np.float64).reshape(len(rows), -1)
        near = x.astype(np.float32)
        # what products of single precision may be off by; pairs as near to the threshold are compared in double precision
        off = (x.shape[1] + 4) * 2.0**-23
        first, other = (np.flatnonzero(part == p) for p in (part.min(), part.max()))
        nodes = root = np.arange(len(rows))
        for start, tile in tiles(near[first], near[other]):
            i, j = np.nonzero(tile > np.float32(threshold - off))
            sure = tile[i, j] > threshold + off
            i, j = first[start + i], other[j]
            for s in range(0, len(i), BLOCK):
                at = np.flatnonzero(~sure[s : s + BLOCK]) + s
                sure[at] = (x[i[at]] * x[j[at]]).sum(axis=1) > threshold
            i, j = i[sure], j[sure]
            if (root[i] != root[j]).any():
                root = _forest(len(rows), np.concatenate([nodes, i]), np.concatenate([root, j]))
        child = np.flatnonzero(root != nodes)
        return pa.table({"a": terms.take(pa.array(root[child])), "b": terms.take(pa.array(child))})

    return links


def _all_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links of distinct unit vectors (term, v), every pair compared; a row goes to as many groups as there are blocks."""
    parts = -(-rows.count() // BLOCK) or 1
    own, other = F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("other")
    pairs = rows.select("term", "v", own, other).withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other"), "size": F.length("v")}).drop("other")
    return pairs.groupBy("size", "low", "high").applyInArrow(_block_links(threshold), "a string, b string")


def similar_links(vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of terms of ``vectors`` (term, embedding), each term once, that connect those whose cosine exceeds ``threshold``.

    An edge may stand for a chain of such pairs. A pair at the threshold is missed with a probability of MISS at most. Buckets give spanning forests, so a group of alike vectors gives fewer links than
    it has members, and none is compared with more than BUCKET others at a time. At thresholds so low that buckets hold a large share of all vectors no pair is missed: all are compared. Vectors of different lengths, or without a direction, are like nothing.
    """
    bands, bits = bands_for(threshold)
    whole = vectors.select("term", F.col("embedding").cast("array<double>").alias("x")).filter(F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("x", lambda c: c != 0))

    def units(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [np.array(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(rows), np.int64)), b.column(0), pa.array([(r / np.linalg.norm(r)).tobytes() for r in rows], pa.binary())], ["key", "term", "v"])

    # equal vectors meet without any comparison
    rows = cut(whole.mapInArrow(units, "key long, term string, v binary"))
    first = rows.groupBy("v").agg(F.min("term").alias("first"))
    same = rows.join(first, "v").filter("term <> first").select(F.col("first").alias("a"), F.col("term").alias("b"))
    if bands * PAYS > 1 << bits:
        return same.unionByName(_all_pairs(first.select(F.col("first").alias("term"), "v"), threshold)).distinct()
    state, found = first.select(F.lit(0).cast("long").alias("key"), F.col("first").alias("term"), "v"), [same]
    for level in range(LEVELS):
        posted = state.mapInArrow(_posted(level, bands, bits), "key long, term string, v binary")
        met = cut(posted.repartition("key").sortWithinPartitions("key", "term").mapInArrow(_linked(threshold, level + 1 == LEVELS), "a string, b string, key long, v binary"))
        found.append(met.filter("b IS NOT NULL").select("a", "b"))
        over = met.filter("b IS NULL")
        if over.isEmpty():
            break
        state = over.select("key", F.col("a").alias("term"), "v")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()
