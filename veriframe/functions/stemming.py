"""English analysis: stop words and suffix stripping by Porter's published algorithm."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: The usual English stop words of search engines.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
WORD = r"[\p{L}\p{N}_]+(?:['’][\p{L}\p{N}_]+)*"

#: The algorithm's suffixes and what takes their place, by step; in steps 2 and 3 after a stem of measure over 0.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()

_V = "(?:[aeiou]|(?<=[^aeiou])y)"
_VOWEL = re.compile(_V)
_SPANS = re.compile(f"{_V}+(?=(?!{_V})[a-z])")
_DOUBLE = re.compile(r"([^aeiouylsz])\1$")


def _measure(stem: str) -> int:
    """How often a vowel run is followed by a consonant."""
    return len(_SPANS.findall(stem))


def _short(stem: str) -> bool:
    """Whether a stem ends consonant, vowel, consonant, the last not w, x or y."""
    kinds = ["v" if _VOWEL.match(stem, k) else "c" for k in range(len(stem))]
    return kinds[-3:] == ["c", "v", "c"] and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    found = [s for s in suffixes if word.endswith(s)]
    return max(found, key=len) if found else None


@lru_cache(200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of other than the letters a to z, and of up to two, stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = None
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    elif word.endswith("ed") and _VOWEL.search(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and _VOWEL.search(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")) or _measure(cut) == 1 and _short(cut):
            cut += "e"
        elif _DOUBLE.search(cut):
            cut = cut[:-1]
        word = cut
    if word.endswith("y") and _VOWEL.search(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        end = _longest(word, table)
        if end and _measure(word[: -len(end)]):
            word = word[: -len(end)] + table[end]
    end = _longest(word, STEP_4)
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


@F.pandas_udf(ArrayType(StringType()))
def _stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for words in batches:
        yield words.map(lambda ws: None if ws is None else [stem(w) for w in ws])


def english_tokens(text: Column) -> Column:
    """Stems of a text's words without stop words and possessive endings, in order. Stemming alone runs in Python, in Arrow batches."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    bare = F.transform(words, lambda w: F.regexp_replace(w, "['’]s$", ""))
    return _stems(F.filter(bare, lambda w: ~w.isin(STOP_WORDS)))
