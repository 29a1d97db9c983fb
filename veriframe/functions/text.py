"""Text expressions: normalisation, tokens, sentence pieces, substring and negation tests. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java counterpart of Python's \w+; below, (?U) makes \s Unicode-aware.
TOKEN = r"[\p{L}\p{N}_]+"
#: What is between tokens.
NO_TOKEN = r"[^\p{L}\p{N}_]+"
#: The characters that (?U)\s matches, for trims.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where a sentence ends: a terminator that isn't the line's first character, with its citations, before white space or the end.
#: It begins with what is rarest, as it is tried at every character.
SENTENCE_END = r"(?U)([.!?](?<=[^\n].)(?:\[[^\]\n]*\])*)(?=\s|\z)"
MARK = "\ue000"
SENTENCE_GAP = r"(?<=[.!?])\s+"

#: What counts as a negation in a normalised text, by substring.
NEGATIONS = (" not ", "no ", "without ", "never ", "fails to", "does not", "cannot")
TRIPLE_NEGATIONS = (" not ", "no ", "without ", "never ", "does not", "cannot")


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(text, F.lit(SPACES))


def normalise(text: Column) -> Column:
    """Lower case, white space collapsed, stripped."""
    return strip(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def all_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def tokens(text: Column) -> Column:
    """Distinct lower-case word tokens, in order of first occurrence."""
    return F.array_distinct(all_tokens(text))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where the value is computed once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _pieces(found: Column, text: Column) -> Column:
    """Stripped pieces without blank ones; the text itself if none is left."""
    return once(F.filter(F.transform(found, strip), lambda x: x != ""), lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(text)))


def sentences(text: Column) -> Column:
    """Terminated sentences; a text without any is one piece, a blank one is itself. Unterminated tails of lines are dropped.

    Ends are marked and lines split at the marks, in time linear in the text; one pattern for whole sentences would try every
    start in an unterminated line. A citation belongs to a sentence's end if it stands in one line.
    """

    def terminated(line: Column) -> Column:
        return once(F.split(line, MARK), lambda parts: F.slice(parts, F.lit(1), F.size(parts) - 1))

    def found(whole: Column) -> Column:
        lines = F.split(F.regexp_replace(whole, SENTENCE_END, "$1" + MARK), "\n")
        return once(F.flatten(F.transform(lines, terminated)), lambda m: F.when(F.size(m) > 0, m).otherwise(F.array(whole)))

    return _pieces(once(strip(text), found), text)


def sentences_with_tails(text: Column) -> Column:
    """The variant that splits after terminators and keeps an unterminated tail."""
    return _pieces(F.split(strip(text), SENTENCE_GAP), text)


def any_of(text: Column, needles: Sequence[str]) -> Column:
    """Whether a text contains one of some strings."""
    hit = F.lit(False)
    for n in needles:
        hit = hit | F.contains(text, F.lit(n))
    return hit


def holds(normal_text: Column, part: Column) -> Column:
    """Whether a normalised text contains a claim's part; an empty part is never held."""
    needle = normalise(part)
    return F.coalesce((needle != "") & F.contains(normal_text, needle), F.lit(False))


def stable_bucket(token: Column, buckets: int) -> Column:
    """A token's bucket by MD5, the same in every process."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % buckets


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def rank_key(score: Column) -> Column:
    """A score as it is ranked: mathematical ties that differ in the last bits stay ties."""
    return F.round(score, 9)
