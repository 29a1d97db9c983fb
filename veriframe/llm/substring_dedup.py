"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest across documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import cut, map_batches, text_or_empty
from veriframe.sources.shared import release

#: The gear hash covers the last 16 bytes: each byte's 32-bit gear moves two bits a step.
WINDOW, STEP = 16, 2
#: A word starts a chunk if the hash before it is greater than at this many words on either side: chunks average seven words.
NEIGHBOURS = 3
#: Repeated chunks in a row count from this many words on. Chunking loses up to about 25 words at a repeated passage's two ends.
MIN_WORDS = 20
#: White-space words of more bytes than this are cut again, at characters where the hash is a local maximum: three characters on average.
LONG_RUN = 64
#: Every ANCHOR words in a row have a hash; of any SPREAD neighbouring ones the least is taken, so a passage of ANCHOR + SPREAD - 1 = 50 words has one.
ANCHOR, SPREAD = 20, 31
#: Bytes of text chunked at once; a longer document is chunked alone, whole.
BATCH_BYTES = 2_000_000

#: Random gears from a fixed seed; the pad byte 0 adds nothing, so that a document's start doesn't depend on what is before it.
GEAR = np.random.default_rng(8).integers(0, 2**32, 256, dtype=np.uint32)
GEAR[0] = 0
_SPACE = np.zeros(256, bool)
_SPACE[[0, 9, 10, 11, 12, 13, 32]] = True
_PAD = bytes(WINDOW)
_WIDE = np.random.default_rng(9).integers(0, 2**64, 256, dtype=np.uint64)
_BLOCK = 1 << 16


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` modulo 2^64: those below _BLOCK, and those of its _BLOCK-th power."""
    high = pow(base, _BLOCK, 2**64)
    return tuple(np.cumprod(np.array([1] + [b] * (_BLOCK - 1), np.uint64)) for b in (base, high))


_BASE = 0x9E3779B97F4A7C15
_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 2**64))


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At every byte, the sum of the gears of the last WINDOW bytes, each shifted by STEP bits for each byte since; by doubling."""
    h, span = GEAR[data], 1
    while span < WINDOW:
        h[span:] += h[:-span] << np.uint32(STEP * span)
        span *= 2
    return h


def _words(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(texts joined, gear hashes, each text's first byte; start, end and text number of every word). Long unspaced runs are cut into several words."""
    joined = _PAD + _PAD.join(texts) + _PAD
    data = np.frombuffer(joined, np.uint8)
    blank = _SPACE[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    gear = gear_hash(data)
    long = ends - starts > LONG_RUN
    if long.any():
        inside = np.zeros(len(data), np.int8)
        inside[starts[long]], inside[ends[long]] = 1, -1
        at = np.flatnonzero((np.cumsum(inside, dtype=np.int8) > 0) & (data & 0xC0 != 0x80))
        value, run = gear[at - 1], np.searchsorted(starts, at, "right")
        peak = (value[1:-1] > value[:-2]) & (value[1:-1] >= value[2:]) & (run[1:-1] == run[:-2]) & (run[1:-1] == run[2:])
        cuts = at[1:-1][peak]
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    begin = np.cumsum([WINDOW, *(len(t) + WINDOW for t in texts)])[:-1]
    return joined, gear, begin, starts, ends, np.searchsorted(begin, starts, "right") - 1


def _described(joined: bytes, begin: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, at: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text number, first word, words, first byte, bytes, and the two halves of the 128-bit digest, of the ``words`` words from each of ``at`` on."""
    lead = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    first_word = at - lead[np.searchsorted(lead, at, "right") - 1]
    start, end = starts[at], ends[at + words - 1]
    digest = xxhash.xxh3_128_digest
    halves = np.frombuffer(b"".join([digest(joined[i:j]) for i, j in zip(start.tolist(), end.tolist())]), ">i8").astype(np.int64).reshape(-1, 2)
    return doc[at], first_word, words, start - begin[doc[at]], end - start, halves[:, 0].copy(), halves[:, 1].copy()


def _nothing() -> tuple[np.ndarray, ...]:
    return tuple(np.empty(0, np.int64) for _ in range(7))


def chunks_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Chunks of some texts: text number, first word, words, first byte, bytes, digest in two halves. Chunks cover every word."""
    return _chunks(*_words(texts))


def _chunks(joined: bytes, gear: np.ndarray, begin: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    if not len(starts):
        return _nothing()
    value = gear[starts - 1]
    lead = np.concatenate([[True], doc[1:] != doc[:-1]])
    peak = np.ones(len(starts), bool)
    for d in range(1, NEIGHBOURS + 1):
        apart = doc[d:] != doc[:-d]
        peak[d:] &= apart | (value[d:] > value[:-d])
        peak[:-d] &= apart | (value[:-d] >= value[d:])
    at = np.flatnonzero(peak | lead)
    return _described(joined, begin, starts, ends, doc, at, np.diff(np.append(at, len(starts))))


def anchors_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Anchors of some texts, as ``chunks_of`` gives chunks: the ANCHOR words of least hash among any SPREAD neighbouring such runs.

    Which run is taken depends on nothing but these ANCHOR + SPREAD - 1 words, so two copies of them share one, whatever is beside them.
    """
    return _anchors(*_words(texts))


def _anchors(joined: bytes, gear: np.ndarray, begin: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    reach = ANCHOR + SPREAD - 1
    if len(starts) < reach:
        return _nothing()
    # hash of bytes i to j: (sums[j] - sums[i]) / base^i, where sums[k] adds up the bytes' numbers times base^place
    sums = np.zeros(len(joined) + 1, np.uint64)
    sums[1:] = _WIDE[np.frombuffer(joined, np.uint8)]
    for k in range(0, len(joined), _BLOCK):
        part = sums[1 + k : 1 + k + _BLOCK]
        part *= _UP[0][: len(part)]
        part *= _UP[1][k // _BLOCK]
    np.cumsum(sums, out=sums)
    i, j = starts[: 1 - ANCHOR], ends[ANCHOR - 1 :]
    value = (sums[j] - sums[i]) * _DOWN[0][i % _BLOCK] * _DOWN[1][i // _BLOCK]
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    near = np.flatnonzero(doc[: 1 - reach or None] == doc[reach - 1 :])
    runs = np.lib.stride_tricks.sliding_window_view(value, SPREAD)
    least = [near[k : k + _BLOCK] + runs[near[k : k + _BLOCK]].argmin(axis=1) for k in range(0, len(near), _BLOCK)]
    if not least:
        return _nothing()
    at = np.unique(np.concatenate(least))
    return _described(joined, begin, starts, ends, doc, at, np.full(len(at), ANCHOR))


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, word, words, start, size, digest, digest2): every chunk and every anchor of every text; positions in words and UTF-8 bytes.

    text_key is the text's 64-bit hash: rows that share an id but not the text are told apart by it."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            group, size, since = [], 0, 0
            for k, t in enumerate(b.column(2)):
                group.append(t.as_py().encode())
                size += len(group[-1])
                if size >= BATCH_BYTES or k + 1 == b.num_rows:
                    found = _words(group)
                    doc, *rest = map(np.concatenate, zip(_chunks(*found), _anchors(*found)))
                    own = pa.array(doc + since)
                    ints = [pa.array(x.astype(np.int32)) for x in rest[:4]]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), *ints, pa.array(rest[4]), pa.array(rest[5])], ["doc_id", "text_key", "word", "words", "start", "size", "digest", "digest2"])
                    group, size, since = [], 0, k + 1

    text = text_or_empty(docs[text_col])
    source = docs.select(docs[id_col].alias("doc_id"), text_key(text).alias("text_key"), text.alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return map_batches(source, batches, f"doc_id {kind}, text_key long, word int, words int, start int, size int, digest long, digest2 long")


def _passage(items: list[tuple], min_words: int) -> Iterator[tuple]:
    """(start, size, words, first_doc_id, kept) of a passage: ``items`` (word, words, start, size, first_doc_id, kept) that leave no gap, by word.

    What some item keeps is kept; the rest of the passage is not.
    """
    first, last = items[0][0], max(w + n for w, n, *_ in items)
    if last - first < min_words:
        return
    kept: list[list] = []  # [word, word after, byte, byte after, first_doc_id]
    for w, n, start, size, doc, keeps in items:
        if keeps and kept and w <= kept[-1][1]:
            if w + n > kept[-1][1]:
                kept[-1][1], kept[-1][3] = w + n, start + size
        elif keeps:
            kept.append([w, w + n, start, start + size, doc])
    others = [x for x in items if not x[5]]
    starts = {w: start for w, _, start, *_ in others}
    ends = {w + n: start + size for w, n, start, size, *_ in others}
    low, high = items[0][2], max(start + size for _, _, start, size, *_ in items)
    word, byte, k, reach, doc = first, low, 0, first, None
    for a, b, start, end, own in [*kept, [last, last, high, high, None]]:
        if a > word:
            while k < len(others) and (reach <= word or doc is None):  # the first item that is over the rest's first word
                reach, doc, k = others[k][0] + others[k][1], others[k][4], k + 1
            lo, hi = starts.get(word, byte), ends.get(a, start)
            yield lo, hi - lo, a - word, doc, False
        if b > a:
            yield start, end - start, b - a, own, True
        word, byte = b, end


def _passages(rows: DataFrame, min_words: int) -> DataFrame:
    """The passages of ``rows`` (doc_id, text_key, word, words, start, size, first_doc_id, kept), which are dealt by the first two and sorted by them and by word."""
    fields = ["word", "words", "start", "size", "first_doc_id", "kept"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, id_, end = [], None, 0
        for b in it:
            ids, out = list(zip(b.column("doc_id").to_pylist(), b.column("text_key").to_pylist())), []

            def close(held: list[tuple], id_: object, out: list[tuple] = out) -> None:
                out += [(*id_, *x) for x in _passage(held, min_words)]

            for i, item in zip(ids, zip(*(b.column(c).to_pylist() for c in fields))):
                if held and (i != id_ or item[0] > end):
                    close(held, id_)
                    held = []
                end = max(end, item[0] + item[1]) if held else item[0] + item[1]
                held.append(item)
                id_ = i
            yield arrow(out, b)
        if held:
            yield arrow([(*id_, *x) for x in _passage(held, min_words)], b)

    def arrow(out: list[tuple], b: pa.RecordBatch) -> pa.RecordBatch:
        kind = b.schema.field("doc_id").type
        kinds = [kind, pa.int64(), pa.int32(), pa.int32(), pa.int32(), kind, pa.bool_()]
        columns = list(zip(*out)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], ["doc_id", "text_key", "start", "size", "words", "first_doc_id", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows.select("doc_id", "text_key", *fields), batches, f"doc_id {kind}, text_key long, start int, size int, words int, first_doc_id {kind}, kept boolean")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Passages that repeat, across documents or in one, one row per occurrence: (doc_id, text_key, start, size, words, first_doc_id, kept).

    A chunk or an anchor repeats if its digest occurs at two places. Repeated ones without a gap make a passage, reported from
    ``min_words`` words on; start and size are UTF-8 bytes of the text. kept is true where the occurrence is the first
    by (doc_id, text_key, word), which stays when the others are removed; a passage is split where that changes. Any 50 words in a row that
    occur twice, byte by byte, share an anchor of 20. Digests have 128 bits.

    Null and empty texts have no chunk. Rows of one id and one text count once; different texts of one id are as different documents. Rows with a null id are ignored. An
    empty table gives an empty result. Extra columns are not read.
    """
    docs = docs.filter(docs[id_col].isNotNull())
    found = chunks(docs, id_col, text_col)
    place = F.struct("doc_id", "text_key", "word")
    ends = found.groupBy("digest", "digest2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = cut(ends.filter("first <> last").select("digest", "digest2", "first"))
    release(docs.sparkSession)  # every chunk was shuffled, and will be again
    hits = found.join(repeated, ["digest", "digest2"]).withColumns({"kept": place == F.col("first"), "first_doc_id": F.col("first.doc_id")})
    dealt = hits.drop("digest", "digest2", "first").repartition("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key", "word", "words")
    return _passages(dealt, min_words)


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of ``spans`` that aren't kept deleted from the text; all other columns as they are, whatever their names.

    A span belongs to the rows of its id that have the text it was found in; spans without a text_key to all rows of their id."""
    keys = [k for k in ("doc_id", "text_key") if k in spans.columns]
    cuts = spans.filter(~F.col("kept")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "size"))).alias("cuts"))
    rows = docs.select(F.struct("*").alias("row"), docs[id_col].alias("doc_id"), text_key(text_or_empty(docs[text_col])).alias("text_key"))
    joined = rows.join(cuts, keys, "left").select("row", "cuts")
    text = F.col("row")[text_col]
    raw = text.cast("binary")

    def end(k: Column) -> Column:
        return F.when(k == 0, 0).otherwise(F.get("cuts", k - 1)["start"] + F.get("cuts", k - 1)["size"])

    # pieces between the cuts, by their byte positions, and the rest; hexadecimal digits are joined, since bytes can't be
    pieces = F.transform("cuts", lambda c, k: F.hex(F.substring(raw, end(k) + 1, c["start"] - end(k))))
    tail = F.hex(F.substring(raw, end(F.size("cuts")) + 1, F.octet_length(raw)))
    kept = F.unhex(F.concat(F.array_join(pieces, ""), tail)).cast("string")
    clean = F.when(F.col("cuts").isNull(), text).otherwise(kept)
    return joined.select(*((clean if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns))
