"""SimHash near-dedup: byte-position inverted index, count filter, verification, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import components, cut, join_spread, map_batches, shuffle_partitions, text_or_empty

BYTES = 8
#: A pair within this many differing bits differs in at most as many bytes, so it shares at least SHARED positional bytes.
RADIUS = 3
SHARED = BYTES - RADIUS
SHINGLE_WORDS = 3
SEED = 42
#: Blocks of four byte positions, numbered so that their XOR is zero. Any three positions lie in exactly one of these 14 blocks, and the
#: other four positions are a block too: bytes that differ lie in a block, so that the pair shares the four bytes of another.
BLOCKS = tuple(c for c in combinations(range(BYTES), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0)
#: A block and one more position: each choice of five positions arises once.
FIVES = tuple((*c, p) for c in BLOCKS for p in range(BYTES) if p not in c)


def _masks(choices: tuple[tuple[int, ...], ...]) -> np.ndarray:
    """Bit masks of byte positions; byte 0 is the most significant."""
    return np.array([sum(0xFF << 8 * (BYTES - 1 - p) for p in c) for c in choices], dtype=np.uint64)


MASKS, FIVE_MASKS = _masks(BLOCKS), _masks(FIVES)
#: Values of one list of a block that a task holds; those of longer lists are listed again under a fifth byte.
LIST_VALUES = 1 << 18
#: Up to this many values all pairs are compared directly; larger sets are split further.
SMALL = 32


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a whole text; 0 if it has no word."""
    joined = b" ".join((text or "").encode().lower().split())
    if not joined:
        return 0
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(spaces + 1).tolist()], [*spaces.tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    if len(starts) < words:
        hashes = [digest(joined, seed)]
    else:
        hashes = [digest(joined[i:j], seed) for i, j in zip(starts, ends[words - 1 :])]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, BYTES), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long, in one pass without a shuffle."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            values = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    source = docs.select(docs[id_col].alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    return map_batches(source, batches, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For n vertices and edges (i, j): the smallest vertex of each vertex's component."""
    root = np.arange(n)
    while len(i):
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if np.array_equal(before, root):
            break
    return root


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Verified pairs: tally the positional bytes that are shared, retain pairs with SHARED of them, count those pairs' differing bits."""
    x = a ^ b
    out = tally(x) >= SHARED
    out[out] = np.bitwise_count(x[out]) <= RADIUS
    return out


def tally(x: np.ndarray) -> np.ndarray:
    """How many positional bytes two fingerprints share, from their XOR."""
    return (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)


def near_links(values: np.ndarray, free: int = 32) -> np.ndarray:
    """Roots (as ``forest``) of the graph of values within RADIUS bits, for values that differ in ``free`` known bits only.

    Small sets compare all pairs. In a large set two near values agree in one of RADIUS + 1 blocks of the free bits, so
    each block in turn splits the set; sets of one block value that are still large look up each value's neighbours,
    whose number is fixed. Work is thus linear in the set for all but small sets.
    """
    n = len(values)
    if n <= SMALL:
        i, j = np.triu_indices(n, 1)
        ok = near(values[i], values[j])
        return forest(n, i[ok], j[ok])
    varying = np.bitwise_or.reduce(values ^ values[0])
    bits = [p for p in range(64) if int(varying) >> p & 1]
    assert len(bits) <= free, "values differ outside the free bits"
    root = np.arange(n)
    if len(bits) > RADIUS:
        for block in np.array_split(np.array(bits, np.uint64), RADIUS + 1):
            mask = np.bitwise_or.reduce(np.uint64(1) << block)
            order = np.argsort(values & mask, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff((values & mask)[order])) + 1):
                if len(part) > 1:
                    i, j = _pairs_in(values[part], [p for p in bits if not int(mask) >> p & 1])
                    root = forest(n, np.concatenate([np.arange(n), part[i]]), np.concatenate([root, part[j]]))
    else:
        root[:] = 0
    return root


def _pairs_in(values: np.ndarray, bits: list[int], most: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of near values: all compared if few; else only each value's possible neighbours are looked up."""
    n = len(values)
    found_i, found_j = [], []
    if n <= most:
        for lag in range(1, n):
            ok = np.flatnonzero(near(values[:-lag], values[lag:]))
            found_i.append(ok)
            found_j.append(ok + lag)
            if sum(map(len, found_i)) > 4 * n:  # a spanning forest says as much
                root = forest(n, np.concatenate(found_i), np.concatenate(found_j))
                found_i, found_j = [np.arange(n)], [root]
    else:
        order = np.argsort(values)
        ranked = values[order]
        for k in range(1, RADIUS + 1):
            for flip in combinations(bits, k):
                other = values ^ np.uint64(sum(1 << p for p in flip))
                at = np.minimum(np.searchsorted(ranked, other), n - 1)
                ok = np.flatnonzero(ranked[at] == other)
                found_i.append(ok)
                found_j.append(order[at[ok]])
            root = forest(n, np.concatenate(found_i), np.concatenate(found_j))
            found_i, found_j = [np.arange(n)], [root]
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.arange(0), np.arange(0))


def _linked(masks: np.ndarray, most: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From postings sorted by (choice, shared bytes): for each list a spanning forest of its near pairs, as (a, b, null).

    A list of more than ``most`` values isn't held: its values are given out as (value, null, choice).
    """

    def overflow(c: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.nulls(len(v), pa.int64()), pa.array(c.astype(np.int8))], ["a", "b", "choice"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_c, held_v, skipped = np.empty(0, np.int64), np.empty(0, np.uint64), None
        for b in it:
            c, v = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if skipped is not None:  # the list that was too long may go on
                same = (c == skipped[0]) & (v & masks[c] == skipped[1])
                n = len(c) if same.all() else int(same.argmin())
                if n:
                    yield overflow(c[:n], v[:n])
                c, v = c[n:], v[n:]
                if not len(c):
                    continue
                skipped = None
            c, v = np.concatenate([held_c, c]), np.concatenate([held_v, v])
            if not len(c):
                continue
            key = v & masks[c]
            last = int(np.flatnonzero((c != c[-1]) | (key != key[-1])).max(initial=-1)) + 1  # the open list may go on
            held_c, held_v = c[last:], v[last:]
            yield from _links(c[:last], key[:last], v[:last])
            if most and len(held_v) > most:
                yield overflow(held_c, held_v)
                skipped = int(held_c[0]), held_v[0] & masks[held_c[0]]
                held_c, held_v = held_c[:0], held_v[:0]
        yield from _links(held_c, held_v & masks[held_c], held_v)

    return batches


def _links(c: np.ndarray, key: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(v) < 2:
        return
    starts = np.concatenate([[0], np.flatnonzero((c[1:] != c[:-1]) | (key[1:] != key[:-1])) + 1, [len(v)]])
    sizes = np.diff(starts)
    run = np.repeat(np.arange(len(sizes)), sizes)
    small = np.flatnonzero((sizes[run] > 1) & (sizes[run] <= SMALL))
    a, b = [], []
    r, s = run[small], v[small]
    i, j = [], []
    for lag in range(1, SMALL):
        at = np.flatnonzero(r[:-lag] == r[lag:])
        if not len(at):
            break
        at = at[near(s[at], s[at + lag])]
        i.append(at)
        j.append(at + lag)
    if i:
        root = forest(len(s), np.concatenate(i), np.concatenate(j))
        child = np.flatnonzero(root != np.arange(len(s)))
        a.append(s[root[child]])
        b.append(s[child])
    for k in np.flatnonzero(sizes > SMALL):
        values = v[starts[k] : starts[k + 1]]
        root = near_links(values)
        child = np.flatnonzero(root != np.arange(len(values)))
        a.append(values[root[child]])
        b.append(values[child])
    if a:
        a, b = (pa.array(np.concatenate(x).view(np.int64)) for x in (a, b))
        yield pa.RecordBatch.from_arrays([a, b, pa.nulls(len(a), pa.int8())], ["a", "b", "choice"])


def _listed(postings: DataFrame, masks: np.ndarray, most: int | None) -> DataFrame:
    """``_linked`` over postings (choice, fp), dealt and sorted by (choice, shared bytes)."""
    shared = F.col("fp").bitwiseAND(F.element_at(_literal(masks), F.col("choice") + 1))
    placed = postings.repartition(shuffle_partitions(postings.sparkSession), "choice", shared).sortWithinPartitions("choice", shared, "fp")
    return map_batches(placed, _linked(masks, most), "a long, b long, choice byte")


def _literal(masks: np.ndarray) -> Column:
    return F.array(*(F.lit(int(m)) for m in masks.view(np.int64)))


def fingerprint_links(distinct: DataFrame, most: int = LIST_VALUES) -> DataFrame:
    """(a, b): edges between distinct fingerprints (column fp) that connect exactly those within RADIUS bits of each other.

    Every fingerprint is posted under the bytes of each of the 14 BLOCKS. Two fingerprints within RADIUS bits share at least SHARED
    positional bytes, among them all of one block, so they meet in a list; others that meet there share four bytes at least, and the tally
    rejects those that don't share a fifth. Lists are dealt by hash, so a big group of near copies is spread over many lists and tasks.
    Lists of more than ``most`` values are posted again under each fifth byte: those lists hold 2^24 values at most, whatever the input.
    """
    masks = _literal(MASKS)
    postings = distinct.select(F.posexplode(masks).alias("choice", "mask"), "fp").select(F.col("choice").cast("byte").alias("choice"), "fp")
    first = cut(_listed(postings, MASKS, most))
    links, dense = first.filter("choice IS NULL").select("a", "b"), first.filter("choice IS NOT NULL")
    if not dense.isEmpty():
        fifth = F.explode(F.sequence(F.col("choice") * 4, F.col("choice") * 4 + 3)).cast("byte").alias("choice")
        links = links.unionByName(_listed(dense.select(fifth, F.col("a").alias("fp")), FIVE_MASKS, None).select("a", "b"))
    return links.distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, fingerprint, component_id).

    Words are runs of anything but ASCII white space, A-Z lower-cased; shingles of three words vote, each with its XXH64. Fingerprints at
    most three bits apart are linked; component_id is the smallest doc_id that links reach. Copies share a fingerprint
    and are expanded only at the end, hot ones in place. Null text counts as empty; a text without a word has fingerprint zero, which
    links like any other. Null ids are ignored when the smallest id is taken (a component of null ids only has null). Repeated rows
    are returned as often as they occur. An empty table gives an empty result. Extra columns are not read.
    """
    marked = cut(fingerprints(docs, id_col, text_col))
    named = _named(marked, F.col("doc_id"), "component_id")
    return join_spread(marked, named, "fp", "n", marked.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _named(marked: DataFrame, value: Column, name: str) -> DataFrame:
    """(fp, name, n): for each fingerprint of ``marked``, how many rows have it, and the least ``value`` among all rows of its component."""
    distinct = cut(marked.groupBy("fp").agg(F.min(value).alias("low"), F.count("*").alias("n")))
    roots = components(fingerprint_links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    members = cut(roots.join(distinct, "fp"))
    lowest = cut(members.groupBy("root").agg(F.min("low").alias(name)))
    linked = members.join(lowest, "root").select("fp", name)
    return cut(distinct.join(linked, "fp", "left").select("fp", F.coalesce(name, "low").alias(name), "n"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, one of each component of near fingerprints: that of the smallest id; rows of a null id all stay.

    Rows are told apart by a number, not by their ids: of rows that repeat an id each is judged by its own text, and of equal rows one stays.
    """
    row = docs.select(F.struct("*").alias("row"))
    rows = cut(row.withColumn("nth", F.monotonically_increasing_id()))
    marked = fingerprints(rows.select("nth", F.col("row")[text_col].alias("text")), "nth", "text").withColumnRenamed("doc_id", "nth")
    ids = rows.select("nth", F.col("row")[id_col].alias("doc_id"))
    marked = cut(marked.join(ids, "nth"))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "nth")
    named = _named(marked, rank, "best")
    dropped = join_spread(marked, named, "fp", "n", marked.count()).filter("doc_id IS NOT NULL AND nth <> best.nth").select("nth")
    return rows.join(cut(dropped), "nth", "left_anti").select("row.*")
