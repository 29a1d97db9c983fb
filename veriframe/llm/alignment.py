"""Cross-tokenizer alignment: where do two tokenizers' tokens of the same text end together, and which tokens do so most often?

Texts are cut into chunks at which both tokenizers always cut, nearly all of them words. Every distinct chunk is aligned once, by joins and windows over
its tokens; a text's groups and links are those of its chunks, one after another.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from veriframe.llm.common import cut, hot_from, map_batches, shuffle_partitions, text_or_empty
from veriframe.llm.packing import BYTE_CHARACTERS
from veriframe.llm.worker import resident
from veriframe.sources.shared import release

#: The white space of the byte-level pre-tokenizer's pattern, without and with the space.
_BLANK = r"\t-\r\x85\xa0  -     　"
_WHITE = " " + _BLANK
#: A chunk begins at a space that follows anything but white space; in the JVM texts are split there, in Python chunks are found whole.
SPLIT = f"(?= )(?<=[^{_WHITE}])"
CHUNK = re.compile(f" [{_WHITE}]*[^{_WHITE}]*(?:[{_BLANK}][{_WHITE}]*[^{_WHITE}]*)*")
_PAIRS = tuple(chr(c) + " " for c in range(0x3001) if re.match(f"[{_WHITE}]", chr(c)))
#: Frequent chunks, at most so many and of so many bytes with their tokens, that are given to every task; those beyond travel to the texts that have them.
HOT_CHUNKS, HOT_BYTES = 1 << 19, 64 << 20
#: Pairs of ids that are given to every task at most, after a count; beyond that they are joined.
PAIRS = 2_000_000
ID_BITS = 32
STATS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
SPACE = "▁"


class Tokens:
    """Both tokenizers, and the bytes that each of their ids stands for."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Tokenizer.from_file(byte_level), SentencePieceProcessor(model_file=pieces)
        self.a.encode_special_tokens = True
        self.space = [self.b.piece_to_id(SPACE)]
        byte_of = {c: b for b, c in BYTE_CHARACTERS.items()}
        level = lambda t: bytes(byte_of[c] if c in byte_of else ord(c) for c in t)
        shown = {i: t for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [level(shown[i]) if i in shown else b"" for i in range(max(shown) + 1)]
        b = self.b
        self.b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace(SPACE, " ").encode() for i in range(b.get_piece_size())]

    @classmethod
    def of(cls, byte_level: str, pieces: str) -> "Tokens":
        _check(byte_level, pieces)
        return resident(("alignment", byte_level, pieces), lambda: cls(byte_level, pieces))

    def encode(self, chunks: list[str]) -> Iterator[tuple[list[int], list[int], bool]]:
        """Per chunk the ids of both, and whether both give the chunk's bytes. The second puts the space in front itself."""
        left, right = self.a.encode_batch(chunks, add_special_tokens=False), self.b.encode([c[1:] for c in chunks], num_threads=1)
        for chunk, one, b in zip(chunks, left, right):
            a, raw = one.ids, chunk.encode()
            b = b if chunk != " " else self.space  # a text's last space; alone it would be an empty text, which gets no space in front
            yield a, b, b"".join([self.a_bytes[i] for i in a]) == raw == b"".join([self.b_bytes[i] for i in b])


def _check(byte_level: str, pieces: str) -> None:
    """Refuses tokenizers that might join something over the places where texts are cut into chunks."""
    from veriframe.llm.sentencepiece_codec import _checked

    _checked(pieces)
    with open(byte_level, encoding="utf-8") as f:
        own = json.load(f)
    pre = own["pre_tokenizer"] or {}
    if own["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
        raise ValueError(f"{byte_level}: only plain byte-level tokenizers with the usual pattern are aligned by chunks")


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """Session settings while a table is made."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Tables dealt by chunk stay so in joins by chunk and end; sorted ones are aggregated in their order.
CO_PARTITIONED = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.execution.useObjectHashAggregateExec": "false"}
SMALL_FILES = {"spark.sql.parquet.compression.codec": "zstd"}


def chunks(text: Column) -> Column:
    """Array of a text's chunks, a space put in front; they cover it whole."""
    return F.split(F.concat(F.lit(" "), text), SPLIT)


def chunks_of(text: str) -> list[str]:
    """The same in Python. Mostly every space begins a chunk: unless one follows white space, splitting at spaces will do."""
    whole = " " + text
    if any(pair in whole for pair in _PAIRS):
        return CHUNK.findall(whole)
    return list(map(" ".__add__, text.split(" ")))


def counted_chunks(docs: DataFrame) -> DataFrame:
    """(chunk, n): how often every chunk occurs in ``docs`` (text)."""
    return docs.filter("text <> ''").select(F.explode(chunks(F.col("text"))).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("n"))


def tokenised(counted: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """(chunk, n, ok, a, a_size, b, b_size): ids of every chunk by both tokenizers, and their sizes in bytes; none where their bytes aren't the chunk's."""

    def columns(ids: list[list[int]], sizes: np.ndarray) -> list[pa.Array]:
        flat = np.fromiter(chain.from_iterable(ids), np.int32)
        ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
        return [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (flat, sizes[flat])]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens.of(byte_level, pieces)
        a_size, b_size = (np.array([len(x) for x in t], np.int16) for t in (tokens.a_bytes, tokens.b_bytes))
        for batch in it:
            a, b, ok = [], [], []
            for one, two, good in tokens.encode(batch.column(0).to_pylist()):
                a.append(one if good else [])
                b.append(two if good else [])
                ok.append(good)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_()), *columns(a, a_size), *columns(b, b_size)], ["chunk", "n", "ok", "a", "a_size", "b", "b_size"])

    return map_batches(counted, batches, "chunk string, n long, ok boolean, a array<int>, a_size array<smallint>, b array<int>, b_size array<smallint>")


def without_lost_texts(words: DataFrame, docs: DataFrame) -> DataFrame:
    """``words`` with n counting only texts whose chunks are all ok; the others have no tokens at all."""
    bad = words.filter("NOT ok").select("chunk")
    if bad.isEmpty():
        return words
    texts = docs.filter("text <> ''").select("text", F.sha2("text", 256).alias("sha"))
    lost = cut(texts.select("sha", F.explode(F.array_distinct(chunks(F.col("text")))).alias("chunk")).join(bad, "chunk", "left_semi").select("sha").distinct())
    less = counted_chunks(texts.join(lost, "sha", "left_semi")).withColumnRenamed("n", "less")
    return cut(words.join(less, "chunk", "left").withColumn("n", F.col("n") - F.coalesce("less", F.lit(0))).drop("less"))


def aligned(words: DataFrame) -> DataFrame:
    """(chunk, n, a_ids, a_groups, b_ids, b_groups, pairs) of every chunk of ``words`` (id, chunk, n, a, a_size, b, b_size).

    Tokens are exploded with their places; cumulative lengths are their ends; ends that both sides have, found by an equality join of chunk and end,
    are cuts; the cuts before a token number its group. pairs are the links: the ids of two tokens that end together. The tokens are
    dealt by chunk once, and all joins and windows keep to that.
    """
    dealt = words.repartition(shuffle_partitions(words.sparkSession), "id")

    def ends(side: str) -> DataFrame:
        each = dealt.select("id", F.posexplode(F.arrays_zip(F.col(side).alias("id"), F.col(f"{side}_size").alias("size"))).alias("pos", "t"))
        order = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return each.select("id", F.sum(F.col("t.size").cast("int")).over(order).alias("end"), F.col("t.id").alias(side))

    def grouped(own: str, other: str) -> DataFrame:
        met = ends(own).join(ends(other), ["id", "end"], "left")
        before = Window.partitionBy("id").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
        return met.withColumn("group", F.count(other).over(before).cast("int"))

    def listed(of: DataFrame, side: str, **more: Column) -> DataFrame:
        rows = of.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("end", F.col(side).alias("token"), "group"))).alias(side), *(c.alias(k) for k, c in more.items()))
        return rows.select("id", F.transform(side, lambda x: x["token"]).alias(f"{side}_ids"), F.transform(side, lambda x: x["group"]).alias(f"{side}_groups"), *more)

    pair = F.when(F.col("b").isNotNull(), F.shiftleft(F.col("a").cast("long"), ID_BITS) + F.col("b"))
    left, right = listed(grouped("a", "b"), "a", pairs=F.collect_list(pair)), listed(grouped("b", "a"), "b")
    return left.join(right, "id").join(dealt.select("id", "chunk", "n"), "id").drop("id")


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, count, best): how often each pair is linked in all texts, and whether none is more often among its second id's."""
    counts = cut(found.filter("n > 0").select(F.explode("pairs").alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1))))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return cut(counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")))


def entries(found: DataFrame, pairs: DataFrame, most: int = PAIRS) -> DataFrame:
    """(chunk, n, n_a, groups, n_best, count_sum): what a text needs to know of each of its chunks; groups as text tell the rest.

    Up to ``most`` pairs are given to every task. More of them are joined to the links, and summed up by chunk.
    """
    fields = ["chunk", "n", "a_ids", "a_groups", "b_ids", "b_groups"]
    small = pairs.limit(most + 1).count() <= most
    if small:
        table = pairs.orderBy("pair").toArrow()
        known = found.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "count", "best")))
        rows = found.select(*fields, "pairs")
    else:
        links = found.select("chunk", F.explode("pairs").alias("pair")).join(pairs, "pair")
        sums = links.groupBy("chunk").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum"))
        rows = found.select(*fields).join(sums, "chunk", "left").select(*fields, F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"))

    def ends(groups: pa.ListArray) -> list[int]:
        """Where the groups of all chunks end, in the flat column of their tokens."""
        flat, starts = groups.flatten().to_numpy(), groups.offsets.to_numpy() - groups.offsets[0].as_py()
        last = np.ones(len(flat), bool)
        last[:-1] = flat[1:] != flat[:-1]
        last[starts[1:] - 1] = True  # no chunk is without tokens
        return (np.flatnonzero(last) + 1).tolist()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            (a, a_end), (c, c_end) = ((list(map(str, b.column(f"{x}_ids").flatten().to_pylist())), ends(b.column(f"{x}_groups"))) for x in "ab")
            own = [f"{','.join(a[i:j])}|{','.join(c[k:m])}" for i, j, k, m in zip([0, *a_end], a_end, [0, *c_end], c_end)]
            groups = b.column("a_groups")
            counts = groups.flatten().to_numpy()[groups.offsets.to_numpy()[1:] - groups.offsets[0].as_py() - 1] + 1
            n_a = pa.array(np.diff(groups.offsets.to_numpy()).astype(np.int32))
            at = [0, *np.cumsum(counts).tolist()]
            texts = pa.array([";".join(own[i:j]) for i, j in zip(at, at[1:])])
            if small:
                column = b.column("pairs")
                flat, lengths = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
                pair, count, best = known.value
                place = np.minimum(np.searchsorted(pair, flat), max(len(pair) - 1, 0))
                hit = pair[place] == flat if len(pair) else np.zeros(len(flat), bool)  # chunks of lost texts alone are in no pair
                row = np.repeat(np.arange(len(lengths)), lengths)[hit]
                rest = [pa.array(np.bincount(row, value[place[hit]], len(lengths)).astype(np.int64)) for value in (best, count)] if len(pair) else [pa.array(np.zeros(len(lengths), np.int64))] * 2
            else:
                rest = [b.column("n_best"), b.column("count_sum")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n_a, texts, *rest], ["chunk", "n", "n_a", "groups", "n_best", "count_sum"])

    return map_batches(rows, batches, "chunk string, n long, n_a int, groups string, n_best long, count_sum long")


def stats_of(entries: pa.Table | pa.StructArray) -> np.ndarray:
    """STATS of chunks, a row each; a group has one link, between the tokens that end it, and a comma stands between two tokens of a side."""
    column = entries.column if isinstance(entries, pa.Table) else entries.field
    number = lambda x: pc.fill_null(x, 0).to_numpy(zero_copy_only=False).astype(np.int64) if isinstance(x, pa.Array) else number(x.combine_chunks())
    n = number(pc.add(pc.count_substring(column("groups"), ";"), 1))
    n_a = number(column("n_a"))
    n_b = number(pc.count_substring(column("groups"), ",")) + 2 * n - n_a
    return np.stack([n_a, n_b, n, n, number(column("n_best")), number(column("count_sum"))], axis=1)


def hot_bound(words: DataFrame, most: int, most_bytes: int) -> int:
    """The least n from which chunks are given to every task: at most ``most`` chunks have it, of ``most_bytes`` with their tokens."""
    step = F.floor(F.log2(F.greatest("n", F.lit(1))) * 8)
    size = F.octet_length("chunk") + 6 * (F.size("a") + F.size("b")) + 64
    bound, keys, total = None, 0, 0
    for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("keys"), F.sum(size).alias("bytes"), F.min("n").alias("n")).orderBy(F.desc("step")).collect():  # at most 8 x 63 rows
        keys, total = keys + r["keys"], total + r["bytes"]
        if keys > most or total > most_bytes:
            break
        bound = r["n"]
    return bound if bound is not None else 1 << 62


class Hot:
    """The frequent chunks: the number of each, and by number its groups (none if not ok) and STATS."""

    def __init__(self, rows: pa.Table):
        self.number = {c: k for k, c in enumerate(rows.column("chunk").to_pylist())}
        self.groups = [g if g is None else g.encode() for g in rows.column("groups").to_pylist()]
        self.stats = stats_of(rows)


def _hot(shared: tuple[str, object]) -> Hot:
    name, table = shared
    return resident(("alignment hot", name), lambda: Hot(pa.ipc.open_stream(zstandard.decompress(table.value)).read_all()))


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return zstandard.compress(sink.getvalue().to_pybytes())


def align(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", hot_chunks: int = HOT_CHUNKS, hot_rows: int | None = None) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    A is the tokenizer of ``byte_level``, over a space and the text, B that of ``pieces``, which puts the space itself. Ends that both share cut the tokens into
    groups and link the two tokens that end there. count_sum adds up how often each link's pair of ids is linked in all texts, n_best counts the
    links whose pair is its B id's most frequent one. groups_sha256 is the digest of the groups' ids, "a1,a2|b1;a3|b2,b3".

    Null and empty texts, and texts whose bytes one of the tokenizers doesn't give back, have no tokens: zeros and an empty string. Repeated rows count
    and are returned as often as they occur; null ids are kept. An empty table gives an empty result. Extra columns are not read.
    """
    source = docs.select(docs[id_col].alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    spark = docs.sparkSession
    with _settings(spark, SMALL_FILES):
        words = cut(tokenised(counted_chunks(source), byte_level, pieces).withColumn("id", F.monotonically_increasing_id()))
        release(spark)
        words = without_lost_texts(words, source)
        with _settings(spark, CO_PARTITIONED):
            found = cut(aligned(words.filter("ok")))
        release(spark)
    pairs, bound = pair_counts(found), hot_bound(words, hot_chunks, HOT_BYTES)
    release(spark)
    lost = words.filter("NOT ok").select("chunk", "n", F.lit(0).alias("n_a"), F.lit(None).cast("string").alias("groups"), *(F.lit(0).cast("long").alias(c) for c in STATS[-2:]))

    def told(which: Column) -> DataFrame:
        return entries(found.filter(which), pairs).unionByName(lost.filter(which))

    frequent = told(F.col("n") >= bound).toArrow().sort_by([("n", "descending")])  # the commonest get the smallest numbers
    shared = uuid.uuid4().hex, spark.sparkContext.broadcast(_packed(frequent))
    return _assembled(source, told(F.col("n") < bound).drop("n"), shared, hot_rows)


def _assembled(source: DataFrame, rare: DataFrame, shared, hot_rows: int | None) -> DataFrame:
    """The report from texts, frequent chunks, and rare ones, which are joined to the texts that have them.

    A text is split and coded once, and dealt by its key; which rare chunks it has is read off its code, where it was dealt to.
    """
    keyed = source.withColumn("key", F.xxhash64("text"))  # texts that share a key just get each other's chunks as well
    kind = source.schema["doc_id"].dataType.simpleString()

    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, squeeze = _hot(shared).number.get, zstandard.ZstdCompressor(level=3).compress
        for b in it:
            names, codes = [], []
            for t in b.column(2):
                own, code = _coded(chunks_of(t.as_py()), number) if len(t.as_py()) else (None, None)
                names.append(squeeze(json.dumps(own, ensure_ascii=False).encode()) if own else None)
                codes.append(squeeze(code) if code else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.binary()), pa.array(codes, pa.binary())], ["doc_id", "key", "names", "packed"])

    def small(rows: DataFrame) -> DataFrame:
        return map_batches(rows.select("doc_id", "key", "text"), packed, f"doc_id {kind}, key long, names binary, packed binary")

    def wanted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keys, out = [], []
            for k, raw in zip(b.column("key").to_pylist(), b.column("names").to_pylist()):
                if raw:
                    own = json.loads(zstandard.decompress(raw))
                    out += own
                    keys += [k] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.string())], ["key", "chunk"])

    def lists(coded: DataFrame) -> DataFrame:
        entry = F.struct("chunk", "n_a", "groups", "n_best", "count_sum")
        return map_batches(coded, wanted, "key long, chunk string").join(rare, "chunk").groupBy("key").agg(F.collect_set(entry).alias("own"))

    def report(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = _hot(shared)
        for b in it:
            own = b.column("own")
            flat = own.flatten()
            names, groups, stats = flat.field("chunk").to_pylist(), flat.field("groups").cast(pa.binary()).to_pylist(), stats_of(flat)
            ends = [0, *np.cumsum(pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False)).tolist()]
            sums, digests = np.zeros((b.num_rows, len(STATS)), np.int64), []
            for k, (raw, rare_names) in enumerate(zip(b.column("packed").to_pylist(), b.column("names").to_pylist())):
                i, j = ends[k], ends[k + 1]
                listed = json.loads(zstandard.decompress(rare_names)) if rare_names else ()
                digests.append(_told(zstandard.decompress(raw), listed, hot, dict(zip(names[i:j], range(i, j))), groups, stats, sums[k]) if raw else "")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(sums[:, k]) for k in range(len(STATS))), pa.array(digests, pa.string())], ["doc_id", *STATS, "groups_sha256"])

    # a text of very many copies is dealt to several tasks, with its rare chunks, if it has any
    count = source.count()
    least = hot_from(count, hot_rows) if hot_rows else hot_from(count)
    copies = cut(keyed.groupBy("key").count().filter(F.col("count") > least).select("key", F.ceil(F.col("count") / least).cast("int").alias("parts")))  # fewer than HOT_KEYS
    fields = ["doc_id", "names", "packed", "own"]
    if copies.isEmpty():
        dealt = small(keyed).repartition("key")  # read twice, made once
        joined = dealt.join(lists(dealt), "key", "left").select(*fields)
    else:
        known = F.broadcast(copies.select("key"))
        dealt = small(keyed.join(known, "key", "left_anti")).repartition("key")
        joined = dealt.join(lists(dealt), "key", "left").select(*fields)
        hot = small(keyed.join(known, "key", "left_semi"))
        salted = hot.join(F.broadcast(copies), "key").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.col("parts")).cast("int")).drop("parts")
        spread = lists(hot).join(F.broadcast(copies), "key").select("key", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
        joined = joined.unionByName(salted.join(spread, ["key", "salt"], "left").select(*fields))
    return map_batches(joined, report, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in STATS) + ", groups_sha256 string")


def _coded(found: list[str], number) -> tuple[list[str], bytes]:
    """A text's rare chunks in the order in which they first occur, and all its chunks as numbers, low bytes first and then the next, which compress well; those of rare chunks are below zero."""
    numbers = np.fromiter(map(number, found, repeat(-1)), "<i4", len(found))
    rare: dict[str, int] = {}
    at = np.flatnonzero(numbers < 0)
    if len(at):
        numbers[at] = [-1 - rare.setdefault(found[k], len(rare)) for k in at.tolist()]
    return list(rare), numbers.view(np.uint8).reshape(-1, 4).T.tobytes()


def _told(coded: bytes, names: list[str], hot: Hot, place: dict[str, int], groups: list[bytes | None], stats: np.ndarray, sums: np.ndarray) -> str:
    """The digest of a text from its coded chunks and its rare ones, ``names``, and its STATS into ``sums``; ``place`` is where ``groups`` and ``stats`` have the latter."""
    n = len(coded) // 4
    at = np.frombuffer(coded, np.uint8).reshape(4, n).T.copy().view("<i4").ravel()
    rare = np.flatnonzero(at < 0) if names else ()
    if names:
        own = np.array([place[c] for c in names])[-1 - at[rare]]
        at[rare] = 0
    parts = list(map(hot.groups.__getitem__, at.tolist())) if hot.groups else [None] * n
    for k, p in zip(rare, own.tolist() if names else ()):
        parts[k] = groups[p]
    if None in parts:
        return ""
    if len(rare):
        sums += stats[own].sum(axis=0)
        at = np.delete(at, rare)
    if len(at):
        sums += hot.stats[at].sum(axis=0)
    return hashlib.sha256(b";".join(parts)).hexdigest()
