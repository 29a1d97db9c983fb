"""Language identification by cross-parsing against suffix automata of labelled text."""

from __future__ import annotations

import gc
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriframe.llm.common import map_batches, text_or_empty
from veriframe.llm.worker import resident

#: Bounds of the labelled sample: languages (those of most rows), characters of training text a language and in all, and
#: documents considered for a language.
SAMPLE_LANGS = 256
SAMPLE_CHARS, SAMPLE_TOTAL = 32_000, 256_000
SAMPLE_DOCS = 256
#: Cells of the table of steps, 4 bytes each, that a worker may hold, and texts from which on a batch is parsed side by side.
TABLE_CELLS = 1 << 25
FEW = 24
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


class SuffixAutomaton:
    """All substrings of a text, as an automaton of at most twice as many states as characters; a state is the dict of its successors."""

    def __init__(self, text: str):
        self.states = states = [{}]
        link, length = [-1], [0]
        last = 0
        for c in text:
            state = len(states)
            states.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in states[p]:
                states[p][c] = state
                p = link[p]
            if p >= 0:
                q = states[p][c]
                if length[q] != length[p] + 1:  # q also ends longer substrings: split it
                    clone = len(states)
                    states.append(dict(states[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = clone
                    while p >= 0 and states[p].get(c) == q:
                        states[p][c] = clone
                        p = link[p]
                    q = clone
                link[state] = q
            last = state
        for successors in states:  # numbers of states become the states themselves
            for c, q in successors.items():
                successors[c] = states[q]
        self.start = states[0]

    def phrases(self, text: str) -> int:
        """Greedy cross-parsing: the number of longest matches that cover ``text``; an unseen character is a phrase."""
        start = here = self.start
        count = 0
        for c in text:
            to = here.get(c)
            if to is None:
                if here is not start:  # the phrase ends; c begins the next
                    count += 1
                    to = start.get(c)
                if to is None:
                    count += 1
                    here = start
                    continue
            here = to
        return count + (here is not start)


def words(text: str) -> str:
    """Lower-cased runs of letters, each closed by a space; a word is parsed with its closing space."""
    return "".join(w + " " for w in _LETTERS.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w)))


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, chars: int, most_docs: int) -> list[tuple[str, str]]:
    """(language, training text) of each language: at most ``most_docs`` documents of it in hash order, up to ``chars`` characters, or
    an equal share of SAMPLE_TOTAL if that is less; of more than SAMPLE_LANGS languages those of most rows, then first by name.

    A hash threshold from the counts of all rows thins each language before any text is read, so that neither a task nor
    the driver gets more than about four times ``most_docs`` documents of a language.
    """
    rows = docs.select(docs[lang_col].alias("lang"), docs[text_col].alias("text"), F.xxhash64(docs[id_col]).alias("h"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(docs[id_col].cast("string").cast("binary")) % 4 != 2))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE_LANGS).collect()}
    if not counts:
        return []
    chars = min(chars, SAMPLE_TOTAL // len(counts))
    part = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(min(1.0, 4 * most_docs / n))) for lang, n in counts.items()), F.lit(0.0))
    thin = rows.filter(F.pmod("h", F.lit(1 << 20)) < part * (1 << 20)).withColumn("text", F.substring("text", 1, chars))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    size = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("h", "text").rowsBetween(Window.unboundedPreceding, -1))
    picked = thin.withColumns({"rank": rank, "before": F.coalesce(size, F.lit(0))}).filter((F.col("rank") <= most_docs) & (F.col("before") < chars))
    texts: dict[str, list[str]] = {}
    for r in picked.orderBy("lang", "rank").select("lang", "text").collect():
        texts.setdefault(r["lang"], []).append(words(r["text"]))
    return [(lang, "".join(parts)[:chars]) for lang, parts in sorted(texts.items()) if any(parts)]


class Model:
    """The automata of all languages; built from the sample once in each Python worker.

    Where they fit TABLE_CELLS they are one table of steps, and the texts of a batch are parsed side by side; else each is parsed by itself.
    """

    def __init__(self, sample: list[tuple[str, str]], cells: int | None = None):
        self.langs = [lang for lang, _ in sample]
        self.automata = [SuffixAutomaton(text) for _, text in sample]
        #: A phrase points into its language's text: so many bits.
        self.bits = [math.log2(max(2, len(text))) for _, text in sample]
        alphabet = sorted(set().union(*(text for _, text in sample)))
        self.width = len(alphabet) + 1
        self.fits = self.width * sum(len(a.states) for a in self.automata) <= (TABLE_CELLS if cells is None else cells)
        if self.fits:
            self.code = np.zeros(0x110000, np.uint16)
            self.code[[ord(c) for c in alphabet]] = np.arange(1, self.width)
            self._tabulate()
            self.automata = []
        gc.freeze()  # the collector needn't walk the states

    def _tabulate(self) -> None:
        """``table``: by a state's place plus a character's code, four times the next state's place plus the phrases that the step ends."""
        parts, self.starts, at = [], [], 0
        for a in self.automata:
            place = {id(q): at + k * self.width for k, q in enumerate(a.states)}
            rows = np.empty((len(a.states), self.width), np.int32)
            fresh = np.full(self.width, 4 * at + 1, np.int32)  # an unseen character is a phrase, and leads back to the start
            for c, q in a.start.items():
                fresh[self.code[ord(c)]] = 4 * place[id(q)]
            rows[:] = fresh + 1  # no match goes on: the phrase ends and the character begins the next
            rows[0] = fresh
            for k, q in enumerate(a.states):
                for c, to in q.items():
                    rows[k, self.code[ord(c)]] = 4 * place[id(to)]
            parts.append(rows.ravel())
            self.starts.append(at)
            at += rows.size
        self.table = np.concatenate(parts) if parts else np.empty(0, np.int32)

    @classmethod
    def of(cls, name: str, sample: Broadcast) -> "Model":
        return resident(("languages", name), lambda: cls(sample.value))

    def phrases(self, texts: list[str]) -> np.ndarray:
        """How many phrases each language needs for each text."""
        if not self.fits:
            return np.array([[a.phrases(t) for t in texts] for a in self.automata], np.int64).reshape(len(self.langs), len(texts))
        size = np.array([len(t) for t in texts], np.int64)
        codes = self.code[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
        order = np.argsort(-size, kind="stable")
        ends = size[order].tolist()
        place = (np.cumsum(size) - size)[order]
        state = np.repeat(np.array(self.starts, np.int32)[:, None], len(texts), axis=1)
        count = np.zeros(state.shape, np.int64)
        at, live = 0, len(texts)
        while live and ends[live - 1] == 0:
            live -= 1
        while live >= FEW:  # all texts that go on take a step together
            s, k, p = state[:, :live].copy(), count[:, :live], place[:live] + at
            for _ in range(ends[live - 1] - at):
                s += codes[p]
                step = self.table[s]
                k += step & 3
                s = step >> 2
                p += 1
            state[:, :live] = s
            at = ends[live - 1]
            while live and ends[live - 1] <= at:
                live -= 1
        steps = memoryview(self.table)
        for j in range(live):  # a few long texts are left
            rest = codes[place[j] + at : place[j] + ends[j]].tolist()
            for i in range(len(self.langs)):
                s, k = int(state[i, j]), 0
                for c in rest:
                    step = steps[s + c]
                    k += step & 3
                    s = step >> 2
                state[i, j] = s
                count[i, j] += k
        count += state != np.array(self.starts)[:, None]  # the last phrase
        out = np.empty_like(count)
        out[:, order] = count
        return out

    def predictions(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """For each text the language that needs fewest phrases, in bits, to cover the whole of it, and its lead over the next, 0 to 1."""
        letters = [words(t) if t else "" for t in texts]
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        bits = self.phrases(letters) * np.array(self.bits)[:, None]
        order = np.argsort(bits, axis=0, kind="stable")  # ties go to the first by name
        found = []
        for j, t in enumerate(letters):
            if not t:
                found.append((UNKNOWN, 0.0))
            elif len(self.langs) == 1:
                found.append((self.langs[0], 1.0))
            else:
                least, second = bits[order[0, j], j], bits[order[1, j], j]
                found.append((self.langs[order[0, j]], float((second - least) / second)))
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predictions([text])[0]


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    train: DataFrame | None = None,
    sample_chars: int = SAMPLE_CHARS,
    sample_docs: int = SAMPLE_DOCS,
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, held_out, lang_pred, score).

    Learns from the text and label of rows of ``train`` (default: ``docs``) that have both and whose crc32(id as text) mod 4
    is not 2; the sample is bounded by ``sample_chars`` and ``sample_docs`` a language, and by SAMPLE_LANGS languages and SAMPLE_TOTAL
    characters in all, so that the automata fit a worker. A prediction parses the whole text, across its words, and reads nothing else.
    Ties go to the language first by name. Null text, and text without a letter, is ``und`` with score 0, as is every text when no
    label can be learned from. A null id is not held out and not learned from. Repeated rows get equal predictions. An empty
    table gives an empty result. Extra columns are not read.
    """
    spark = docs.sparkSession
    learned = labelled_sample(train if train is not None else docs, id_col, text_col, lang_col, sample_chars, sample_docs)
    sample, name = spark.sparkContext.broadcast(learned), uuid.uuid4().hex

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(name, sample)
        for b in it:
            found = model.predictions(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    held_out = F.coalesce(F.crc32(docs[id_col].cast("string").cast("binary")) % 4 == 2, F.lit(False))
    source = docs.select(docs[id_col].alias("doc_id"), held_out.alias("held_out"), text_or_empty(docs[text_col]).alias("text"))
    return map_batches(source, batches, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_chars: int = SAMPLE_CHARS, sample_docs: int = SAMPLE_DOCS, least_score: float = 0.0) -> DataFrame:
    """The rows of ``docs``, whole, whose text has a language: those that ``identify`` calls ``und`` or scores below ``least_score`` go.
    Where ``lang_col`` is null it becomes the predicted language. No shuffle.

    Where no label can be learned from, only rows without a letter go, and no language is filled in.
    """
    learned = labelled_sample(docs, id_col, text_col, lang_col, sample_chars, sample_docs)
    sample, name = docs.sparkSession.sparkContext.broadcast(learned), uuid.uuid4().hex
    at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(name, sample)

        def found(texts: list[str | None]) -> list[tuple[str | None, float]]:
            return model.predictions(texts) if model.langs else [(None if t and words(t) else UNKNOWN, 1.0) for t in texts]

        for b in it:
            langs, scores = zip(*found(b.column(at).to_pylist())) if b.num_rows else ((), ())
            filled = pc.coalesce(b.column(lang_at), pa.array(langs, b.column(lang_at).type))
            keep = pa.array([x != UNKNOWN and s >= least_score for x, s in zip(langs, scores)], pa.bool_())
            yield b.set_column(lang_at, b.schema.field(lang_at), filled).filter(keep)

    return map_batches(docs, batches, docs.schema)
