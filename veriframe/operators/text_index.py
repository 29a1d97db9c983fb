"""A stored inverted index of chunks, searched with bounds of blocks: BM25, overlap and Jaccard, exactly as the scans give them.

A segment is a folder: chunks numbered in the order of their ids, with their tokens, and postings in blocks. A block holds a token's postings in one range of
1 << RANGE_BITS numbers, with what bounds their scores. A search reads the heads of the asked tokens' blocks, adds up their bounds by query and range, reads
the few best ranges of each query, and then only ranges whose bound reaches the k-th best score found there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriframe.functions import text as T
from veriframe.operators.chunking import tokenised
from veriframe.operators.joins import broadcast_if_small
from veriframe.operators.retrieval import BLOCK_ROWS, PLAN_TOKENS, SLACK, top_k
from veriframe.sources.shared import cut
from veriframe.sources.versions import Folders

#: Chunks of one block, as a power of two.
RANGE_BITS = 12
#: Scores within this of each other may rank alike.
RANKED = 1e-8
#: Ranges of a query that are read first, those of the greatest bounds.
FIRST = 2
K1, B = 1.2, 0.75
HEAD = ("token", "range", "n", "max_tf", "min_size", "min_distinct")
SCORES = ("bm25", "overlap", "jaccard")


def term_counts(tokens: Column) -> Column:
    """Array of (token, tf) of an array of tokens: runs of the sorted array, in time linear but for the sort."""

    def runs(s: Column) -> Column:
        edges = F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i == 0) | (i == F.size(s)) | ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
        return T.once(edges, lambda e: F.transform(F.slice(e, F.lit(1), F.size(e) - 1), lambda b, k: F.struct(F.get(s, b).alias("token"), (F.get(e, k + 1) - b).alias("tf"))))

    return F.when(F.size(tokens) > 0, T.once(F.sort_array(tokens), runs))


def _block(number: int, docs: np.ndarray, lists: pa.ListArray, range_bits: int) -> pa.RecordBatch:
    """The blocks of one range, in order of their tokens, from its chunks' numbers and tokens."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    words = pc.list_flatten(lists).dictionary_encode()
    order = pc.sort_indices(words.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    pairs, tfs = np.unique(rank[words.indices.to_numpy()] * len(docs) + np.repeat(np.arange(len(docs)), sizes), return_counts=True)
    token, own = pairs // len(docs), pairs % len(docs)
    distincts = np.bincount(own, minlength=len(docs))[own]
    starts = np.flatnonzero(np.diff(token, prepend=-1))
    columns = (docs[own] & ((1 << range_bits) - 1), tfs, sizes[own], distincts)
    offsets = pa.array(np.append(starts, len(pairs)), pa.int32())
    heads = (np.diff(np.append(starts, len(pairs))), np.maximum.reduceat(tfs, starts), np.minimum.reduceat(sizes[own], starts), np.minimum.reduceat(distincts, starts))
    arrays = [words.dictionary.take(pa.array(order)), pa.array(np.full(len(starts), number), pa.int64()), *(pa.array(h, pa.int32()) for h in heads)]
    arrays += [pa.ListArray.from_arrays(offsets, pa.array(c, pa.int32())) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, [*HEAD, "places", "tfs", "sizes", "distincts"])


def postings(docs: DataFrame, range_bits: int = RANGE_BITS) -> DataFrame:
    """Blocks (HEAD..., places, tfs, sizes, distincts) of numbered chunks (doc, all), whose partitions are in order of the numbers; a block has at most
    1 << ``range_bits`` postings.

    A range's chunks follow each other, so its blocks are made where they are read: no posting is shuffled. Of a range that lies in two partitions
    there are two blocks a token, whose bounds add up to a bound.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def closed() -> Iterator[pa.RecordBatch]:
            lists = pa.concat_arrays([x for _, x in held]) if held else None
            if lists is not None and pc.any(pc.greater(pc.list_value_length(lists), 0)).as_py():
                yield _block(current, np.concatenate([d for d, _ in held]), lists, range_bits)

        for b in it:
            doc = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(doc >> range_bits)) + 1), len(doc)]
            for start, end in zip(edges, edges[1:]):
                if start == end:
                    continue
                if doc[start] >> range_bits != current:
                    yield from closed()
                    current, held = int(doc[start] >> range_bits), []
                held.append((doc[start:end], b.column(1).slice(start, end - start)))
        yield from closed()

    arrays = ", ".join(f"{c} array<int>" for c in ("places", "tfs", "sizes", "distincts"))
    return docs.select("doc", "all").mapInArrow(batches, f"token string, range long, n int, max_tf int, min_size int, min_distinct int, {arrays}")


def _best_of_range(score: str, mean: float, k: int, range_bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """From one range's queries (query_id, n_query, names) and the blocks of their tokens: (query_id, segment, doc, score) of the chunks that
    can be among a query's k best; of chunks that score the same, the k greatest.

    A range's blocks meet here once, however many queries ask for them; nothing is shuffled for a posting and a query.
    """

    def best(wanted: pa.Table, blocks: pa.Table) -> pa.Table:
        rows, docs, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        distinct, parts = np.ones(1 << range_bits), {}
        for n, (name, weight) in enumerate(zip(*(blocks.column(c).to_pylist() for c in ("name", "weight"))) if len(wanted) else ()):
            place, tf, size, own = (blocks.column(c)[n].values.to_numpy() for c in ("places", "tfs", "sizes", "distincts"))
            distinct[place] = own
            parts.setdefault(name, []).append((place, weight * (_saturated(tf, size, mean) if score == "bm25" else 1.0)))
        number = (int(blocks.column("range")[0].as_py()) << range_bits) if parts else 0
        for n, (n_query, names) in enumerate(zip(*(wanted.column(c).to_pylist() for c in ("n_query", "names"))) if parts else ()):
            sums = np.zeros(1 << range_bits)
            for name in names:
                for place, part in parts.get(name, ()):
                    sums[place] += part
            at = np.flatnonzero(sums)
            value = sums[at] / (n_query + distinct[at] - sums[at]) if score == "jaccard" else sums[at]
            if len(at) > k:
                near = value >= np.partition(value, len(at) - k)[len(at) - k] - RANKED
                at, value = at[near], value[near]
                order = np.lexsort((at, value))
                at, value = at[order], value[order]
                later = np.append(value[k:] == value[:-k], np.zeros(k, bool))
                at, value = at[~later], value[~later]
            rows.append(np.full(len(at), n))
            docs.append(number + at)
            scores.append(value)
        row = pa.array(np.concatenate(rows))
        return pa.table({"query_id": wanted.column("query_id").take(row), "segment": wanted.column("segment").take(row), "doc": np.concatenate(docs), "score": np.concatenate(scores)})

    return best


class TextIndex:
    """Segments of an index under ``path``. ``analyse`` turns texts into tokens, those of chunks and those of queries alike."""

    def __init__(self, spark: SparkSession, path: str, analyse: Callable[[Column], Column] = T.all_tokens):
        self.spark, self.path, self.analyse = spark, path.rstrip("/"), analyse
        self.folders = Folders(spark, self.path)

    def exists(self) -> bool:
        return bool(self.folders.live())

    def clear(self) -> "TextIndex":
        """Name a version without segments; the folders stay for running readers."""
        self.folders.name([])
        return self

    def add(self, chunks: DataFrame) -> "TextIndex":
        """Write chunks (chunk_id, text), or tokenised ones (chunk_id, all), as one more segment. Ids must be new."""
        terms = chunks.select("chunk_id", "all") if "all" in chunks.columns else tokenised(chunks, self.analyse)
        folder = self._write(terms)
        self.folders.name([*self.folders.live(), folder])
        return self

    def _write(self, terms: DataFrame) -> str:
        folder = self.folders.new()
        path = f"{self.path}/{folder}"
        # numbers follow the ids, so that of equal scores the greater number is the greater id
        terms.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id").withColumn("doc", F.monotonically_increasing_id()).write.parquet(f"{path}/docs")
        docs = self.spark.read.parquet(f"{path}/docs")
        docs.agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.size("all")), F.lit(0)).cast("long").alias("tokens")).write.parquet(f"{path}/stats")
        docs.groupBy(F.shiftright("doc", RANGE_BITS).alias("range")).agg(F.max("chunk_id").alias("last_id")).write.parquet(f"{path}/ranges")
        postings(docs, RANGE_BITS).sortWithinPartitions("token", "range").write.parquet(f"{path}/postings")
        return folder

    def merge(self, most_chunks: int | None = None, least_segments: int = 2) -> "TextIndex":
        """Write all segments, or those of at most ``most_chunks`` chunks, as one, once there are ``least_segments``."""
        live = self.folders.live()
        if len(live) < least_segments:
            return self
        small = [f for f in live if most_chunks is None or self.spark.read.parquet(f"{self.path}/{f}/stats").first()["chunks"] <= most_chunks]
        if len(small) > 1:
            folder = self._write(self.spark.read.parquet(*(f"{self.path}/{f}/docs" for f in small)).select("chunk_id", "all"))
            self.folders.name([*(f for f in live if f not in small), folder])
        return self

    def terms(self) -> DataFrame:
        """(chunk_id, all) of all segments, as ``chunking.tokenised`` gives them."""
        return self.folders.read("docs").select("chunk_id", "all")

    def vocabulary(self) -> DataFrame:
        """(token, df): in how many chunks every token is."""
        return self.folders.read("postings").select("token", "n").groupBy("token").agg(F.sum("n").alias("df"))

    def _read(self, table: str) -> DataFrame:
        """A table of all segments, with the segment's number."""
        parts = [self.spark.read.parquet(p).withColumn("segment", F.lit(k)) for k, p in enumerate(self.folders.paths(table))]
        return reduce(DataFrame.unionByName, parts)

    def _asked(self, queries: DataFrame, fuzzy: Callable[[DataFrame, DataFrame], DataFrame] | None) -> DataFrame:
        """(query_id, token, n_query): the distinct tokens to look up; ``fuzzy`` may replace (query_id, token) by what is like it in the vocabulary."""
        tokens = F.array_distinct(self.analyse(F.col("query")))
        rows = cut(queries.select("query_id", F.size(tokens).alias("n_query"), F.explode(tokens).alias("token")))
        if fuzzy is None:
            return rows
        found = fuzzy(rows.select("query_id", "token"), self.vocabulary())
        return cut(found.join(rows.select("query_id", "n_query").distinct(), "query_id"))

    def _with(self, table: DataFrame, asked: DataFrame) -> DataFrame:
        """``table``'s rows of asked tokens; few tokens are part of the scan, which then skips most row groups."""
        names = [r["token"] for r in asked.select("token").distinct().limit(PLAN_TOKENS + 1).collect()]
        if len(names) <= PLAN_TOKENS:
            return table.filter(F.col("token").isin(names))
        return table.join(broadcast_if_small(asked.select("token").distinct()), "token", "left_semi")

    def _bounds(self, asked: DataFrame, score: str) -> tuple[DataFrame, DataFrame, float]:
        """(query_id, token, n_query, weight) of the asked tokens that are there; (query_id, segment, range, blocks, bound); the mean size of a chunk."""
        heads = cut(self._with(self._read("postings").select("segment", *HEAD), asked))
        totals = self.folders.read("stats").agg(F.sum("chunks").alias("chunks"), F.sum("tokens").alias("tokens")).first()
        mean = totals["tokens"] / totals["chunks"] if totals["chunks"] and totals["tokens"] else 1.0
        df = F.col("df")
        idf = F.log(1 + (totals["chunks"] - df + 0.5) / (df + 0.5)) if score == "bm25" else F.lit(1.0)
        weights = heads.groupBy("token").agg(F.sum("n").alias("df")).select("token", idf.alias("weight"))
        known = cut(asked.join(broadcast_if_small(weights), "token"))
        part = F.col("weight") * _saturated(F.col("max_tf"), F.col("min_size"), mean) if score == "bm25" else F.lit(1.0)
        met = heads.join(broadcast_if_small(known), "token")
        sums = met.groupBy("query_id", "segment", "range").agg(F.sum(part).alias("bound"), F.count("*").alias("blocks"), F.min("min_distinct").alias("least"), F.first("n_query").alias("n_query"))
        if score == "jaccard":
            sums = sums.withColumn("bound", F.col("blocks") / (F.col("n_query") + F.greatest(F.col("least") - F.col("blocks"), F.lit(0))))
        return known, cut(sums.select("query_id", "segment", "range", "blocks", "bound")), mean

    def _scored(self, ranges: DataFrame, known: DataFrame, score: str, mean: float, k: int) -> DataFrame:
        """(query_id, segment, doc, score): the best chunks of each query and segment in some ranges (query_id, segment, range), scored exactly."""
        # a query's tokens go to every range that it asks for, so they go as numbers, and the weights with the blocks
        named = cut(known.select("token", "weight").distinct().withColumn("name", F.monotonically_increasing_id()))
        asked = cut(known.join(broadcast_if_small(named.select("token", "name")), "token").groupBy("query_id", "n_query").agg(F.sort_array(F.collect_list("name")).alias("names")))
        parts = -(-asked.count() // BLOCK_ROWS) or 1
        part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part")
        wanted = ranges.join(broadcast_if_small(asked), "query_id").select("segment", "range", part, "query_id", "n_query", "names")
        blocks = self._with(self._read("postings").select("segment", "token", "range", "places", "tfs", "sizes", "distincts"), known)
        blocks = blocks.join(broadcast_if_small(ranges.select("segment", "range").distinct()), ["segment", "range"], "left_semi").join(broadcast_if_small(named), "token").drop("token").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        keys = ("segment", "range", "part")
        kind = wanted.schema["query_id"].dataType.simpleString()
        sums = wanted.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(_best_of_range(score, mean, k, RANGE_BITS), f"query_id {kind}, segment int, doc long, score double")
        order = Window.partitionBy("query_id", "segment").orderBy(T.rank_key(F.col("score")).desc(), F.desc("doc"))
        best = sums.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).drop("n")
        docs = self._read("docs").select("segment", "doc", "chunk_id")
        return docs.join(broadcast_if_small(cut(best)), ["segment", "doc"]).select("query_id", "chunk_id", "score")

    def _search(self, queries: DataFrame, k: int, score: str, fuzzy: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(results, bounds, what of them was read)."""
        if score not in SCORES:
            raise ValueError(f"score is one of {', '.join(SCORES)}")
        known, bounds, mean = self._bounds(self._asked(queries, fuzzy), score)
        greatest = Window.partitionBy("query_id").orderBy(F.desc("bound"), F.desc("segment"), F.desc("range"))
        ranked = cut(bounds.withColumn("n", F.row_number().over(greatest)))
        first = cut(top_k(self._scored(ranked.filter(F.col("n") <= FIRST), known, score, mean, k), k))
        least = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min(F.struct(T.rank_key(F.col("score")).alias("score"), "chunk_id"))).alias("least"))
        rest = ranked.filter(F.col("n") > FIRST).join(broadcast_if_small(least), "query_id", "left")
        rest = rest.filter(F.col("least").isNull() | (F.col("bound") >= F.col("least.score") - SLACK)).join(self._read("ranges"), ["segment", "range"])
        rest = cut(rest.filter(F.col("least").isNull() | (F.col("bound") > F.col("least.score") + SLACK) | (F.col("last_id") > F.col("least.chunk_id"))).drop("least", "last_id"))
        second = self._scored(rest, known, score, mean, k)
        read = ranked.filter(F.col("n") <= FIRST).unionByName(rest)
        return top_k(first.drop("rank").unionByName(second), k), bounds, read

    def search(self, queries: DataFrame, k: int, score: str = "bm25", fuzzy: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
        """(query_id, chunk_id, score, rank): the ``k`` best chunks of queries (query_id, query), as a scan of all chunks would give them.

        ``score`` is bm25, overlap (distinct tokens shared) or jaccard. Queries without a known token find nothing.
        """
        return self._search(queries, k, score, fuzzy)[0]

    def blocks_read(self, queries: DataFrame, k: int, score: str = "bm25") -> DataFrame:
        """(query_id, blocks, read): how many blocks hold a query's tokens, and how many of them a search reads beyond their heads."""
        _, bounds, read = self._search(queries, k, score)
        every = bounds.groupBy("query_id").agg(F.sum("blocks").alias("blocks"))
        return every.join(read.groupBy("query_id").agg(F.sum("blocks").alias("read")), "query_id")


def _saturated(tf: Column | np.ndarray, size: Column | np.ndarray, mean: float) -> Column | np.ndarray:
    """What a token's frequency adds to BM25 before its weight; grows with the frequency, falls with the chunk's size."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
