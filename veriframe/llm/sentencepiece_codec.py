"""SentencePiece encoding and decoding by a streaming Viterbi search with a bounded window."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

from veriframe.llm.common import map_batches, text_or_empty
from veriframe.llm.worker import resident

SPACE = "▁"
#: Chunks (a word and the spaces before it) up to LONG_CHUNK characters are kept with their ids, this many in a Python worker.
CHUNK_CACHE = 800_000
LONG_CHUNK = 48
#: Beginnings of chunks, of so many characters, whose backpointers are kept, and how many.
HEADS = (7, 5, 3)
PREFIX_CACHE = 200_000
#: Characters of text that are split into chunks at once, and of a chunk that enter the stream at once.
SLICE = 1 << 20
BLOCK = 256


class Pieces:
    """A model's pieces. ``score`` is a log probability, or minus the merge rank where ``merges`` is true."""

    def __init__(self, score: dict[str, float], ids: dict[str, int], byte_ids: list[int], unk_id: int, merges: bool):
        self.score, self.ids, self.byte_ids, self.unk_id, self.merges = score, ids, byte_ids, unk_id, merges
        self.longest = max(map(len, score), default=1)
        #: How long the pieces are that end with two characters, ascending.
        self.sizes: dict[str, list[int]] = {}
        for end, size in sorted({(p[-2:], len(p)) for p in score if len(p) > 1}):
            self.sizes.setdefault(end, []).append(size)
        self.compatible = lru_cache(500_000)(self._compatible)
        self.encoded = {p: i.to_bytes(4, "little") for p, i in ids.items()}

    @classmethod
    def load(cls, path: str) -> "Pieces":
        sp = SentencePieceProcessor(model_file=path)
        n = range(sp.get_piece_size())
        plain = [i for i in n if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        names = {i: sp.id_to_piece(i) for i in plain}
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        merges = _checked(path) == 2
        return cls({names[i]: sp.get_score(i) for i in plain}, {names[i]: i for i in plain}, byte_ids, sp.unk_id(), merges)

    def merged(self, text: str) -> list[str]:
        """Merge the adjacent pair of the best rank, leftmost first, until none is left; for short texts."""
        parts, get, none = list(text), self.score.get, -float("inf")
        ranks = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (top := max(ranks)) > none:
            k = ranks.index(top)
            parts[k] += parts.pop(k + 1)
            ranks.pop(k)
            if k:
                ranks[k - 1] = get(parts[k - 1] + parts[k], none)
            if k < len(ranks):
                ranks[k] = get(parts[k] + parts[k + 1], none)
        return parts

    def _compatible(self, before: str, piece: str) -> bool:
        """Whether merging the two pieces' text gives just these two; after no piece, whether the second comes out whole."""
        return self.merged(before + piece) == [before, piece] if before in self.score else self.merged(piece) == [piece]

    def id_bytes(self, piece: str) -> bytes:
        """Little-endian 32-bit ids: the piece's own, or its UTF-8 bytes', or the unknown id."""
        if piece in self.encoded:
            return self.encoded[piece]
        if self.byte_ids and self.byte_ids[0] != self.unk_id:
            return b"".join(self.byte_ids[x].to_bytes(4, "little") for x in piece.encode())
        return self.unk_id.to_bytes(4, "little")


def _checked(path: str) -> int:
    """The type of a model that this search codes as its library does: 1 for unigram, 2 for BPE; any other is refused."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    rules, spaced = model.normalizer_spec, [p.piece for p in model.pieces if SPACE in p.piece.lstrip(SPACE)]
    faults = {
        "its type is neither unigram nor BPE": model.trainer_spec.model_type not in (1, 2),
        "it normalises": bool(rules.precompiled_charsmap) or rules.remove_extra_whitespaces or not rules.escape_whitespaces,
        "it has no space in front": not rules.add_dummy_prefix or model.trainer_spec.treat_whitespace_as_suffix,
        "it has pieces of a user": any(p.type == p.USER_DEFINED for p in model.pieces),
        "a piece holds a space after another character": bool(spaced),
    }
    if any(faults.values()):
        raise ValueError(f"{path}: {', '.join(k for k, v in faults.items() if v)}")
    return model.trainer_spec.model_type


#: What a character that is no piece costs among scored pieces: more than any piece.
UNKNOWN_SCORE = -1e4


def viterbi(blocks: Iterable[str], pieces: Pieces, prefixes: dict[str, list[str]] | None = None) -> Iterator[str]:
    """Pieces of a stream of characters, which comes in blocks, in memory bounded by the window in which paths differ.

    Each position keeps one backpointer, its last piece: for scored pieces that of the best path; for
    merge-ranked pieces that of the one last piece that the merges of its prefix can end with. Only the last ``longest``
    positions can be stepped from; once the paths back from all of them pass through one boundary, everything before it is given out.
    ``prefixes`` keeps the backpointers of the stream's first positions (HEADS) by what it begins with, since many streams begin alike.
    """
    return chain.from_iterable(_runs(blocks, pieces, prefixes))


def _runs(blocks: Iterable[str], pieces: Pieces, prefixes: dict[str, list[str]] | None) -> Iterator[list[str]]:
    """What ``viterbi`` gives out, as it commits it."""
    step, longest = (_merge_step if pieces.merges else _score_step), pieces.longest
    text, last, best = "", [""], [0.0]  # from the last boundary given out; place 0 is that boundary
    heads = HEADS if prefixes is not None and pieces.merges else ()
    for block in blocks:
        text += block
        n = len(last)
        if n == 1:  # nothing has been stepped over yet
            for m in heads:
                if m <= len(text) and (kept := prefixes.get(text[:m])):
                    last += kept
                    n = m + 1
                    break
        while n <= len(text):
            piece = step(text, n, pieces, last, best)
            last.append(piece)
            if n >= 2 * longest and n % longest == 0 and (meet := _meeting(last, n - longest + 1, n)):
                yield _path(last, meet)
                text, heads, n = text[meet:], (), n - meet
                del last[:meet], best[:meet]
            elif n in heads:
                if len(prefixes) >= PREFIX_CACHE:
                    prefixes.clear()
                prefixes[text[:n]] = last[1 : n + 1]
            n += 1
    yield _path(last, len(last) - 1)


def _merge_step(text: str, n: int, pieces: Pieces, last: list[str], best: list[float]) -> str:
    """The one piece that the merges of the first n characters end with, from the last pieces of shorter prefixes."""
    score, compatible, piece = pieces.score, pieces.compatible, text[n - 1 : n]
    # beside a piece it must survive the merges of both; beside anything else nothing can reach across
    if piece not in score or compatible(last[n - 1], piece):
        return piece
    for k in pieces.sizes.get(text[n - 2 : n], ()) if n > 1 else ():
        if k > n:
            break
        piece = text[n - k : n]
        if piece in score and compatible(last[n - k], piece):
            return piece
    raise ValueError("the pieces aren't a merge table: a prefix has no last piece")


def _score_step(text: str, n: int, pieces: Pieces, last: list[str], best: list[float]) -> str:
    """The last piece of the best path over the first n characters, whose score joins ``best``."""
    top = None
    for k in range(1, min(n, pieces.longest) + 1):
        piece = text[n - k : n]
        if piece in pieces.score or k == 1:
            score = best[n - k] + pieces.score.get(piece, UNKNOWN_SCORE)
            if top is None or score >= top[0]:  # of equal paths the one with the longer last piece
                top = score, piece
    best.append(top[0])
    return top[1]


def _meeting(last: list[str], low: int, n: int) -> int:
    """The greatest boundary that the paths back from all places low..n share."""
    front = set(range(low, n + 1))
    while len(front) > 1:
        top = max(front)
        front.discard(top)
        front.add(top - len(last[top]))
    return front.pop()


def _path(last: list[str], end: int) -> list[str]:
    out = []
    while end > 0:
        out.append(last[end])
        end -= len(last[end])
    return out[::-1]


def blocks(text: str) -> Iterable[str]:
    """A text as a stream; a short one is a single block."""
    return (text,) if len(text) <= BLOCK else (text[k : k + BLOCK] for k in range(0, len(text), BLOCK))


class Codec(dict):
    """Encoding and decoding with one model that has the identity normaliser and a dummy space in front; a cache of chunks' ids.

    A chunk is a word with the spaces before it, or a character that is in no piece and hence never joins another. All paths meet at its
    ends, since no piece reaches over them, so every chunk is a stream of its own, of any length, and equal ones have equal ids.
    """

    def __init__(self, path: str):
        super().__init__()
        self.pieces = Pieces.load(path)
        ids, raw = self.pieces.ids, self.pieces.byte_ids
        self.names = [""] * (max([*ids.values(), *raw, self.pieces.unk_id]) + 1)
        self.names[self.pieces.unk_id] = " ⁇ "
        for piece, i in ids.items():
            self.names[i] = piece
        self.byte_of = {i: b for b, i in enumerate(raw) if i != self.pieces.unk_id}
        for i, b in self.byte_of.items():
            self.names[i] = chr(b)  # right for ASCII; decode() looks at the others
        self.high = np.array([i for i, b in self.byte_of.items() if b > 127], np.uint32)
        self.prefixes: dict[str, list[str]] = {}
        runs = [k for k in range(1, self.pieces.longest + 1) if SPACE * k in ids]
        self.run = max(runs, default=1)
        inside = "".join(set("".join(ids)))
        alone = "".join(c for c in "\n\t\r" if c not in inside)
        self.split = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + f"|[{alone}]" * bool(alone)).findall

    def _spaces(self, count: int) -> bytes:
        """Ids of a run of spaces: the merges extend from the left, up to the longest run that is a piece."""
        full, rest = divmod(count, self.run)
        return self.pieces.id_bytes(SPACE * self.run) * full + (self.pieces.id_bytes(SPACE * rest) if rest else b"")

    def _chunk(self, chunk: str) -> bytes:
        if not self.pieces.merges:
            return b"".join(map(self.pieces.id_bytes, viterbi(blocks(chunk), self.pieces)))
        word = chunk.lstrip(SPACE)
        spaces = len(chunk) - len(word)
        if not word:
            return self._spaces(spaces)
        # runs of spaces merge last, so the word takes its space first if it can
        text = SPACE + word if spaces else word
        parts = viterbi(blocks(text), self.pieces, self.prefixes)
        if spaces < 2 and (head := next(parts)) != SPACE:  # most chunks: a word that takes its space
            return b"".join(map(self.pieces.id_bytes, chain((head,), parts)))
        head = SPACE if spaces < 2 else next(parts)
        taken = 1 if spaces and head != SPACE else 0
        first = self._spaces(spaces - taken) if spaces > taken else b""
        return first + (b"" if head == SPACE else self.pieces.id_bytes(head)) + b"".join(map(self.pieces.id_bytes, parts))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit bytes."""
        if not text:
            return b""
        text, out, at = SPACE + text.replace(" ", SPACE), [], 0
        while at < len(text):
            end = at + SLICE
            cut = text.find(SPACE, end) if end < len(text) else -1  # a slice ends before the spaces of a word
            end = len(text) if cut < 0 else cut
            while text[end - 1 : end] == SPACE and end < len(text) and end - 1 > at:
                end -= 1
            out.append(b"".join(map(self.__getitem__, self.split(text[at:end]))))
            at = end
        return b"".join(out)

    def __missing__(self, chunk: str) -> bytes:
        ids = self._chunk(chunk)
        if len(chunk) <= LONG_CHUNK:
            if len(self) >= CHUNK_CACHE:
                self.clear()
            self[chunk] = ids
        return ids

    def decode(self, ids: bytes) -> str:
        """The text of some ids: bytes join to UTF-8 (faulty ones give U+FFFD), control ids give nothing."""
        numbers = np.frombuffer(ids, "<u4")
        if not len(self.high) or not np.isin(numbers, self.high).any():
            text = "".join(map(self.names.__getitem__, numbers.tolist()))
        else:
            out, raw = [], bytearray()
            for i in numbers.tolist():
                b = self.byte_of.get(i)
                if b is not None:
                    raw.append(b)
                    continue
                if raw:
                    out.append(raw.decode(errors="replace"))
                    raw.clear()
                out.append(self.names[i])
            text = "".join(out) + raw.decode(errors="replace")
        text = text.replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def codec(path: str) -> Codec:
    return resident(("chunks", path), lambda: Codec(path))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_ids, and what ``outputs`` names.

    ids: array of int. ids_crc32: unsigned CRC-32 of the ids as little-endian 32-bit numbers. round_trip: whether decoding gives the text
    back; it does unless the text holds U+2581, the model's sign for a space. A model that normalises, has pieces of a user, or
    joins over spaces is refused. Null and empty texts have no ids. Repeated rows get
    equal results, null ids are kept, an empty table gives an empty result. Extra columns are not read.
    """
    types = {"ids": ("array<int>", pa.list_(pa.int32())), "ids_crc32": ("long", pa.int64()), "round_trip": ("boolean", pa.bool_())}

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model)
        for b in it:
            count, columns, whole = [], {name: [] for name in outputs}, []
            for t in b.column(1):
                text = t.as_py()
                ids = tool.encode(text)
                count.append(len(ids) // 4)
                if "ids" in columns:
                    whole.append(ids)
                if "ids_crc32" in columns:
                    columns["ids_crc32"].append(zlib.crc32(ids))
                if "round_trip" in columns:
                    columns["round_trip"].append(tool.decode(ids) == text)
            if "ids" in columns:
                ends = pa.array(np.cumsum([0, *count], dtype=np.int32))
                columns["ids"] = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(whole), "<i4")))
            arrays = [v if name == "ids" else pa.array(v, types[name][1]) for name, v in columns.items()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), *arrays], ["doc_id", "n_ids", *outputs])

    source = docs.select(docs[id_col].alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_ids long" + "".join(f", {name} {types[name][0]}" for name in outputs)
    return map_batches(source, batches, schema)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from ids; null ids count as none and give an empty text."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model)
        for b in it:
            texts = [tool.decode(pa.array(x.as_py() or [], pa.int32()).to_numpy().tobytes()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    source = encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids"))
    return map_batches(source, batches, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text string")
