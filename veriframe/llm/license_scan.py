"""License scans: Dice coefficient over word bigrams against templates, pruned by size."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from veriframe.llm.common import map_batches, text_or_empty
from veriframe.llm.license_texts import TEMPLATES

THRESHOLD = 0.8
#: Bounds are compared with this much to spare, so that a coefficient of just the threshold is never lost to rounding.
ROUNDING = 1e-9
_WORD = re.compile(r"[a-z0-9]+")
#: Words so common that a bigram of two of them says little; only the order of pruning depends on them.
COMMON = frozenset("a an and any as at be by for from in is it of on or that the this to was with".split())


def words(text: str) -> list[str]:
    """Normalised text: lower-cased runs of ASCII letters and digits, in American spelling."""
    return _WORD.findall(text.lower().replace("licence", "license"))


def bigrams(ws: list[str]) -> Counter:
    return Counter(zip(ws, ws[1:]))


class Templates:
    """Templates by name, and the few bigrams of each of which any match must have one."""

    def __init__(self, texts: dict[str, str], threshold: float):
        self.threshold = threshold
        self.grams = {name: bigrams(words(t)) for name, t in texts.items()}
        self.sizes = {name: g.total() for name, g in self.grams.items()}
        # Dice >= t needs |A and B| >= t (|A| + |B|) / 2 and, as |A| >= |A and B|, at least t / (2 - t) of |B|: so a
        # match misses at most the rest of B's bigrams, and has one of any set of them that outweighs the rest.
        self.keys: set[tuple[str, str]] = set()
        for name, grams in self.grams.items():
            spare, weight = self.sizes[name] * (1 - threshold / (2 - threshold)), 0
            for g, n in sorted(grams.items(), key=lambda x: (sum(w in COMMON for w in x[0]), -sum(map(len, x[0])), x[0])):
                if weight > spare + ROUNDING:
                    break
                self.keys.add(g)
                weight += n
        #: Every key's places: (template, number of the bigram).
        self.where: dict[tuple[str, str], list[tuple[str, int]]] = {}
        for name, text in texts.items():
            ws = words(text)
            for place, g in enumerate(zip(ws, ws[1:])):
                if g in self.keys:
                    self.where.setdefault(g, []).append((name, place))

    def best(self, ws: list[str]) -> tuple[float, str]:
        """The best Dice coefficient and its template; (0, '') if none reaches the threshold."""
        own, top, name_of = None, 0.0, ""
        n, t = len(ws) - 1, self.threshold
        for name, size in self.sizes.items():
            if n * (2 - t) < t * size - ROUNDING or size * (2 - t) < t * n - ROUNDING:  # too short or too long to reach the threshold
                continue
            own = own or bigrams(ws)
            dice = 2 * sum(min(c, own[g]) for g, c in self.grams[name].items() if g in own) / (n + size)
            if (dice, name) > (top, name_of):  # of equal ones the last by name
                top, name_of = dice, name
        return (top, name_of) if top >= t else (0.0, "")

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """(first line, lines, template, Dice) of every match, in order; matches don't overlap.

        Windows are placed in the words of the whole text by each key's places in a template, and grow to their best Dice. That with most
        matching bigrams goes first; the others go on in the words it leaves. Lines that no window touches are compared as a whole.
        """
        low = text.lower().replace("licence", "license")
        ws = _WORD.findall(low)
        grams = list(zip(ws, ws[1:]))
        if self.keys.isdisjoint(grams):
            return []
        places: dict[tuple[str, int], list[int]] = {}
        keyed = [i for i, g in enumerate(grams) if g in self.where]
        for i in keyed:
            for name, place in self.where[grams[i]]:
                places.setdefault((name, max(0, i - place)), []).append(i)
        shared: dict[str, list[int]] = {}
        taken: list[tuple[int, int, str, float]] = []  # (first word, word after the last, template, Dice), in order
        heap: list[tuple] = []

        def push(name: str, start: int, lo: int, hi: int) -> None:
            if name not in shared:
                own = self.grams[name]
                shared[name] = [0, *accumulate(g in own for g in grams)]
            if (found := self._grow(name, grams, shared[name], start, lo, hi)) is not None:
                first, after, matched, dice = found
                heappush(heap, (_Last((matched, dice, name)), first, after, start))

        def gap(i: int) -> tuple[int, int] | None:
            """The words without a match around the bigram at ``i``; None if it is in a match."""
            k = bisect_right(taken, i, key=lambda t: t[0])
            lo = taken[k - 1][1] if k else 0
            hi = taken[k][0] if k < len(taken) else len(ws)
            return (lo, hi) if lo <= i and i + 1 < hi else None

        for name, start in places:
            push(name, start, 0, len(ws))
        while heap:
            order, first, after, start = heappop(heap)
            _, dice, name = order.value
            room = gap(first)
            if room and after <= room[1]:
                insort(taken, (first, after, name, dice))
                continue
            for lo, hi in {g for i in places[name, start] if (g := gap(i))}:
                push(name, start, lo, hi)
        line_of = self._lines(low)
        first_in = {}
        for i in keyed:
            first_in.setdefault(line_of[i], i)
        for line, i in first_in.items():
            lo, hi = bisect_left(line_of, line), bisect_right(line_of, line)
            if (room := gap(i)) and room[0] <= lo and hi <= room[1]:
                dice, name = self.best(ws[lo:hi])
                if name:
                    insort(taken, (lo, hi, name, dice))
        return [(line_of[i], line_of[j - 1] - line_of[i] + 1, name, dice) for i, j, name, dice in taken]

    @staticmethod
    def _lines(low: str) -> list[int]:
        """The line of every word of a normalised text."""
        return [k for k, line in enumerate(low.split("\n")) for _ in _WORD.finditer(line)]

    def _grow(self, name: str, grams: list[tuple[str, str]], shared: list[int], start: int, lo: int, hi: int) -> tuple[int, int, int, float] | None:
        """The window of best Dice within words ``lo`` to ``hi`` near ``start``: (first word, word after the last, matching bigrams, Dice)."""
        size, t = self.sizes[name], self.threshold
        longest, least = int(size * (2 - t) / t + ROUNDING), size * t / (2 - t) - ROUNDING
        start, stop = max(start, lo), hi - 1
        if shared[max(0, min(stop, start + longest))] - shared[max(lo, start - longest)] < least:
            return None
        _, after = self._best_end(name, (grams[i] for i in range(start, min(stop, start + longest))), size)
        after += start
        (matched, dice), back = self._best_end(name, (grams[i] for i in range(after - 1, max(lo, after - longest) - 1, -1)), size)
        return (after - back, after + 1, matched, dice) if dice >= t else None

    def _best_end(self, name: str, grams: Iterator[tuple[str, str]], size: int) -> tuple[tuple[int, float], int]:
        """((matching bigrams, Dice), bigrams) of the run from the first bigram on whose Dice is best; the shortest of several."""
        left, matched, best, at = dict(self.grams[name]), 0, (0, 0.0), 0
        for n, g in enumerate(grams, 1):
            if left.get(g, 0):
                left[g] -= 1
                matched += 1
                dice = 2 * matched / (n + size)
                if dice > best[1]:
                    best, at = (matched, dice), n
        return best, at


class _Last:
    """Turns the order round, so that a heap gives the greatest value first."""

    def __init__(self, value: tuple):
        self.value = value

    def __lt__(self, other: _Last) -> bool:
        return self.value > other.value

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Last) and self.value == other.value


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per licence text found: (doc_id, line, lines, license, dice); line counts from 0.

    Every match from the threshold on is found, wherever its lines break; matches don't overlap. Null and empty texts, and texts
    without a licence, give no row. Repeated rows each give theirs. Of matches that overlap that with most matching bigrams counts, then the
    best Dice, then the template last by name. Null ids are kept. An empty
    table gives an empty result. Extra columns are not read.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, threshold)
        for b in it:
            rows = [(k, *m) for k, t in enumerate(b.column(1)) for m in known.scan(t.as_py())]
            k, line, lines, name, dice = zip(*rows) if rows else ((),) * 5
            ids = b.column(0).take(pa.array(k, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(line, pa.int32()), pa.array(lines, pa.int32()), pa.array(name, pa.string()), pa.array(dice, pa.float64())], ["doc_id", "line", "lines", "license", "dice"])

    source = docs.select(docs[id_col].alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    return map_batches(source, batches, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, line int, lines int, license string, dice double")
