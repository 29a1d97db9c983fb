"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands."""

from __future__ import annotations

import json
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veriframe.llm.common import cut, map_batches, shuffle_partitions, text_or_empty
from veriframe.llm.worker import resident

CAPACITY = 4096
END_ID = 1
#: Words whose ids a Python worker keeps; it starts afresh when they are more. Longer words than LONG_WORD bytes aren't kept.
WORD_CACHE = 900_000
TOKEN_CACHE = 300_000
LONG_WORD = 64
#: A long text is split into words this many bytes at a time.
SLICE = 1 << 20
#: Pieces in a shard, about; both when all are dealt and when those of underfilled sequences are dealt again.
SHARD_PIECES = 4096
#: Sequences filled less than this are opened, and their pieces packed again with those of other shards.
WELL_FILLED = 0.995
ISLANDS, POPULATION, GENERATIONS, EPOCHS = 2, 8, 25, 2
#: Bins that a displaced item looks at for a smaller one to take the place of.
TRIES = 16
_SPACE = re.compile(rb"\s")
#: Words of these characters only (printable ASCII and Latin letters) are split here just as the tokenizer splits them.
PLAIN = re.compile("[!-~ªµºÀ-ÖØ-öø-įı-ɏ]+")
PRE_TOKENS = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zªµºß-öø-ɏ]+|[0-9]|[^a-z0-9ªµºß-öø-ɏ]+")
#: The pre-tokenizer that PRE_TOKENS stands for; with any other, words go to the tokenizer as they are.
WORD_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level vocabularies write bytes that have no visible Latin-1 character as the characters from 256 on, in order.
BYTE_CHARACTERS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class WordEncoder(dict):
    """Token ids of whole texts as little-endian 32-bit bytes, equal to the tokenizer's; a cache of words' ids.

    The pre-tokenizer never joins anything across ASCII white space and the normaliser works within it, so a
    text's ids are those of its white-space-separated words, one after another.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.tokens: dict[str, bytes] = {}
        self.split_alike = json.loads(self.tokenizer.to_str())["pre_tokenizer"] == WORD_SPLIT

    def __missing__(self, word: bytes) -> bytes:
        """A word's ids: by its pre-tokens where its characters leave no doubt about them, else by the tokenizer."""
        text = word.decode()
        if self.split_alike and PLAIN.fullmatch(text) and "<|" not in text:
            get = self.tokens.get
            ids = b"".join([get(t) or self._token(t) for t in PRE_TOKENS.findall(text.lower())])
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= LONG_WORD:
            if len(self) >= WORD_CACHE:
                self.clear()
            self[word] = ids
        return ids

    def _token(self, token: str) -> bytes:
        """One pre-token's ids, straight from the merges."""
        mapped = token if token.isascii() else token.encode().decode("latin-1").translate(BYTE_CHARACTERS)
        own = self.id_bytes
        ids = b"".join([own[t.id] for t in self.merge(mapped)])
        if len(token) <= LONG_WORD:
            if len(self.tokens) >= TOKEN_CACHE:
                self.tokens.clear()
            self.tokens[token] = ids
        return ids

    def encode(self, text: str) -> bytes:
        raw, out, at = text.encode(), [], 0
        while at < len(raw):
            end = space.start() if (space := _SPACE.search(raw, at + SLICE)) else len(raw)  # a slice ends with a word
            out.append(b"".join(map(self.__getitem__, raw[at:end].split())))
            at = end
        return b"".join(out)


def encoder(path: str) -> WordEncoder:
    return resident(("words", path), lambda: WordEncoder(path))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids binary]): every document's ids, then ``end_id``, cut only where longer than ``capacity``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        last = end_id.to_bytes(4, "little")
        for b in it:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, t in enumerate(b.column(1)):
                whole = encode(t.as_py()) + last
                for p, at in enumerate(range(0, len(whole), 4 * capacity)):
                    part = whole[at : at + 4 * capacity]
                    row.append(k)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(part)
            columns = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.binary())] if keep_ids else [])], [*names, *["ids"] * keep_ids])

    source = docs.select(docs[id_col].alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return map_batches(source, batches, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


class Bins:
    """A packing under change: items by bin, and the bins by the room they have left."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.left = capacity, [], []
        self.by_left: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0  # bit r is set if a bin with r tokens left may exist

    def add(self, items: list[int], left: int) -> None:
        self.items.append(items)
        self.left.append(left)
        self._list(len(self.left) - 1, left)

    def _list(self, b: int, left: int) -> None:
        self.by_left[left].append(b)
        self.mask |= 1 << left

    def best_fit(self, item: int, size: int) -> None:
        """Into the fullest bin that has room, or a new one."""
        fits = self.mask >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            bins = self.by_left[left]
            b = bins.pop()
            if not bins:
                self.mask &= ~(1 << left)
            self.items[b].append(item)
            self.left[b] = left - size
            self._list(b, left - size)
        else:
            self.add([item], self.capacity - size)


def packed(sizes: list[int], order: list[int], capacity: int) -> list[list[int]]:
    bins = Bins(capacity)
    for i in order:
        bins.best_fit(i, sizes[i])
    return bins.items


def fitness(packing: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins are better; of equal numbers, uneven filling, since it leaves room in one place. Greater is better."""
    return -len(packing), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in packing)


def _refilled(kept: list[list[int]], loose: list[int], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """``kept`` bins with ``loose`` items best-fitted; before that, a loose item takes the place of a smaller one where it fills a bin better."""
    kept = [list(b) for b in kept]
    left = [capacity - sum(sizes[i] for i in b) for b in kept]
    displaced = []
    for i in sorted(loose, key=lambda i: (-sizes[i], i)):
        gain, size = 0, sizes[i]
        for b in rng.sample(range(len(kept)), min(TRIES, len(kept))):
            if left[b] > gain:
                for k, other in enumerate(kept[b]):
                    if gain < size - sizes[other] <= left[b]:
                        gain, at, place = size - sizes[other], b, k
        if gain:
            kept[at][place], i = i, kept[at][place]
            left[at] -= gain
        displaced.append(i)
    bins = Bins(capacity)
    for b, room in zip(kept, left):
        bins.add(b, room)
    for i in sorted(displaced, key=lambda i: (-sizes[i], i)):
        bins.best_fit(i, sizes[i])
    return bins.items


def crossover(one: list[list[int]], two: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Inject well-filled whole bins of ``two`` into ``one``, drop its bins that hold a duplicate, best-fit what that displaces."""
    fill = [sum(sizes[i] for i in b) for b in two]
    ranked = sorted(range(len(two)), key=lambda k: -fill[k])
    good = [two[k] for k in ranked[: max(1, len(ranked) // 2)] if rng.random() < 0.5]
    injected = {i for b in good for i in b}
    whole = [b for b in one if injected.isdisjoint(b)]
    displaced = [i for b in one if not injected.isdisjoint(b) for i in b if i not in injected]
    return _refilled(good + whole, displaced, sizes, capacity, rng)


def mutated(packing: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Open the emptiest bins and a few others, and best-fit their items."""
    ranked = sorted(range(len(packing)), key=lambda k: sum(sizes[i] for i in packing[k]))
    opened = {*ranked[:3], *(rng.randrange(len(packing)) for _ in range(2))}
    kept = [b for k, b in enumerate(packing) if k not in opened]
    return _refilled(kept, [i for k in opened for i in packing[k]], sizes, capacity, rng)


def _bin_of(packing: list[list[int]], n: int) -> bytes:
    out = np.empty(n, "<i4")
    for k, b in enumerate(packing):
        out[b] = k
    return out.tobytes()


def _packing(bins: bytes) -> list[list[int]]:
    at = np.frombuffer(bins, "<i4")
    out: list[list[int]] = [[] for _ in range(int(at.max(initial=-1)) + 1)]
    for i, b in enumerate(at.tolist()):
        out[b].append(i)
    return out


def evolve(sizes: list[int], island: list[bytes], capacity: int, seed: int, population: int, generations: int) -> list[bytes]:
    """Some generations on one island, from its packings (none: fresh ones), best first. Ends early at the lower bound."""
    rng, n = random.Random(seed), len(sizes)
    bound = -(-sum(sizes) // capacity)
    decreasing = sorted(range(n), key=lambda i: (-sizes[i], i))
    group = [_packing(b) for b in island] or [packed(sizes, decreasing, capacity)]
    group.sort(key=lambda p: fitness(p, sizes, capacity), reverse=True)
    if len(group[0]) > bound:
        while len(group) < population:  # noisy decreasing orders
            noise = {i: sizes[i] * rng.uniform(0.7, 1.3) for i in range(n)}
            group.append(packed(sizes, sorted(range(n), key=lambda i: -noise[i]), capacity))
        group.sort(key=lambda p: fitness(p, sizes, capacity), reverse=True)
    for _ in range(generations):
        if len(group[0]) == bound:
            break
        one, two = group[0], rng.choice(group[1:])
        for a, b in ((one, two), (two, one)):
            group.append(mutated(crossover(a, b, sizes, capacity, rng), sizes, capacity, rng))
        group.sort(key=lambda p: fitness(p, sizes, capacity), reverse=True)
        del group[population:]
    return [_bin_of(p, n) for p in group]


def _islands(shards: DataFrame, capacity: int, islands: int, population: int, generations: int, epochs: int) -> DataFrame:
    """(shard, bins): the best packing of each shard's sizes that its islands find; elites move round the ring between epochs."""
    schema = "shard long, island int, sizes binary, group array<binary>, bins int, square double"

    def run(epoch: int):
        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                for row in b.to_pylist():
                    sizes = np.frombuffer(row["sizes"], "<i4").tolist()
                    seed = zlib.crc32(b"%d %d %d" % (row["shard"], row["island"], epoch))
                    group = evolve(sizes, row["group"], capacity, seed, population, generations)
                    best, square = fitness(_packing(group[0]), sizes, capacity)
                    out = row | {"group": group, "bins": -best, "square": square}
                    yield pa.RecordBatch.from_pylist([out], pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("sizes", pa.binary()), ("group", pa.list_(pa.binary())), ("bins", pa.int32()), ("square", pa.float64())]))

        return batches

    n = shuffle_partitions(shards.sparkSession)
    state = shards.withColumn("island", F.explode(F.lit(list(range(islands))))).withColumn("group", F.array().cast("array<binary>"))
    for epoch in range(epochs):
        ready = state.select("shard", F.col("island").cast("int").alias("island"), "sizes", "group").repartition(n, "shard", "island")
        state = cut(map_batches(ready, run(epoch), schema))
        if epoch + 1 < epochs:
            elites = state.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.col("group")[0].alias("elite"))
            state = state.join(elites, ["shard", "island"]).select("shard", "island", "sizes", F.concat(F.array("elite"), "group").alias("group"))
    return state.groupBy("shard").agg(F.min_by(F.col("group")[0], F.struct("bins", (-F.col("square")).alias("s"), "island")).alias("packing"), F.first("sizes").alias("sizes"))


def _placed(items: DataFrame, capacity: int, **options) -> DataFrame:
    """(shard, doc_id, piece, ..., bin, offset, fill) for items with a shard of bounded size."""

    def sized(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sizes = [np.array(x, "<i4").tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.binary())], ["shard", "sizes"])

    def offsets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for row in b.to_pylist():
                sizes, bins = np.frombuffer(row["sizes"], "<i4"), np.frombuffer(row["packing"], "<i4")
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(sizes[order])
                first = np.concatenate([[True], np.diff(bins[order]) > 0]) if len(order) else np.empty(0, bool)
                base = (ends - sizes[order])[first]
                fill = np.diff(np.concatenate([base, ends[-1:]]))
                at = np.empty(len(order), np.int64)
                at[order] = ends - sizes[order] - base[bins[order]]
                places = [{"bin": int(k), "offset": int(o), "fill": int(f)} for k, o, f in zip(bins, at, fill[bins])]
                kind = pa.list_(pa.struct([("bin", pa.int32()), ("offset", pa.int64()), ("fill", pa.int32())]))
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]], pa.int64()), pa.array([places], kind)], ["shard", "places"])

    inside = F.struct((-F.col("length")).alias("less"), "doc_id", "piece", "start", "length", "ids_crc32")
    grouped = cut(items.groupBy("shard").agg(F.sort_array(F.collect_list(inside)).alias("items")))
    sizes = map_batches(grouped.select("shard", F.transform("items", lambda x: x["length"].cast("int")).alias("sizes")), sized, "shard long, sizes binary")
    best = map_batches(_islands(sizes, capacity, **options), offsets, "shard long, places array<struct<bin:int,offset:long,fill:int>>")
    rows = grouped.join(best, "shard").select("shard", F.explode(F.arrays_zip("items", "places")).alias("x"))
    return rows.select("shard", *(f"x.items.{c}" for c in ("doc_id", "piece", "start", "length", "ids_crc32")), "x.places.bin", "x.places.offset", "x.places.fill")


def pack_pieces(items: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, islands: int = ISLANDS, population: int = POPULATION, generations: int = GENERATIONS, epochs: int = EPOCHS) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset added.

    ``items`` must be a stored table, which is read in the same order when a lost task runs again. Pieces are dealt by hash to shards of about ``shard_pieces``; each shard is packed on ``islands`` islands. Then the
    sequences that are left underfilled are opened, and their pieces, of all shards, are dealt and packed once more.
    """
    options = {"islands": islands, "population": population, "generations": generations, "epochs": epochs}
    count = items.count()
    shards = max(1, -(-count // shard_pieces))
    # by rows of the stored tables too, so that equal ones fill no shard
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))
    first = cut(_placed(dealt, capacity, **options))
    full = F.col("fill") >= int(WELL_FILLED * capacity)
    again = first.filter(~full).select("doc_id", "piece", "start", "length", "ids_crc32")
    shards = max(1, -(-again.count() // shard_pieces))
    second = _placed(again.withColumn("shard", F.pmod(F.xxhash64("ids_crc32", "piece", "doc_id", F.monotonically_increasing_id()), F.lit(shards))), capacity, **options)

    def named(df: DataFrame, level: int) -> DataFrame:
        sequence = (F.col("shard") * (1 << 24) + F.col("bin")) * 2 + level
        return df.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset")

    return named(first.filter(full), 0).unionByName(named(second, 1))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, keep_ids: bool = False, **options) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids binary]).

    A document is its whole text's ids and then ``end_id``; only one longer than ``capacity`` is cut. A sequence holds up to
    ``capacity`` tokens without gaps. Null and empty texts are the end id alone. Repeated rows are packed as often as they
    occur. Null ids are kept. An empty table gives an empty result. Extra columns are not read.
    """
    items = cut(pieces(docs, tokenizer, capacity, id_col, text_col, end_id, keep_ids))
    packed = pack_pieces(items.drop("ids"), capacity, **options)
    if not keep_ids:
        return packed
    # packing needs no ids, so they join its rows at the end; repeated rows have equal ones
    keys = ["doc_id", "piece", "length", "ids_crc32"]
    own = items.select(*(F.col(c).alias(f"__{c}") for c in keys), "ids").dropDuplicates([f"__{c}" for c in keys])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    return packed.join(own, same).drop(*(f"__{c}" for c in keys))
