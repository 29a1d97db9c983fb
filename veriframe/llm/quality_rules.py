"""Quality rules: countable facts of each text, and a hashed n-gram likelihood ratio against a trusted target. DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import WHITE_SPACE_RUN, cut, text_or_empty, without_white_space
from veriframe.operators.joins import is_small

#: The characters that are counted as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Hash buckets that words and pairs of neighbouring words fall into.
BUCKETS = 10_000
#: A pair's bucket mixes its words' hashes with this factor.
FACTOR = 31
#: Log ratios are kept as integers, in units of 2^-UNIT_BITS nats: sums don't depend on their order.
UNIT_BITS = 20
#: The target's shares are those of its n-grams and of this many more that fall as the raw corpus does: a small target says little, a large one all.
PRIOR = 50_000
#: The least mean log ratio (nats an n-gram) of a kept text.
THRESHOLD = -0.11
#: Trusted ids that are broadcast at most, after a count; beyond that the join shuffles.
TRUSTED_IDS = 2_000_000


def _let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE_SPACE_RUN), lambda w: w != "")


def ngrams(ws: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of every word, then of every pair of neighbouring words, repeats included."""

    def of(h: Column) -> Column:
        pairs = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))), lambda x, k: F.pmod(x * FACTOR + F.get(h, k + 1), F.lit(buckets)))
        return F.concat(F.transform(h, lambda x: F.pmod(x, F.lit(buckets))), pairs)

    return _let(F.transform(ws, lambda w: F.crc32(w.cast("binary"))), of)


def repeated_words(ws: Column, size: int = WINDOW_WORDS) -> Column:
    """How many words stand in a window of ``size`` words that the text has twice or more. Windows are compared by 64-bit hashes.

    Linear where no window repeats; else the windows are sorted by hash, and those that equal a neighbour cover words from their place on.
    """

    def covered(places: Column) -> Column:
        def step(s: Column, p: Column) -> Column:
            return F.struct((s["n"] + F.least(F.lit(size), p + size - s["end"])).cast("int").alias("n"), (p + size).cast("int").alias("end"))

        return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda s: s["n"])

    def twice(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
        same = lambda x, o, k: F.coalesce(x["h"] == F.get(o, k)["h"], F.lit(False))
        found = _let(order, lambda o: F.filter(F.transform(o, lambda x, k: F.when(((k > 0) & same(x, o, k - 1)) | same(x, o, k + 1), x["k"])), lambda p: p.isNotNull()))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(covered(F.sort_array(found)))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - size + 1), lambda i: F.xxhash64(F.slice(h, i, size)))

    return F.when(F.size(ws) < size, 0).otherwise(_let(_let(F.transform(ws, lambda w: F.xxhash64(w)), windows), twice))


def symbols(text: Column) -> Column:
    """Characters of SYMBOLS; they are single bytes, and plain replacement is faster than a pattern."""
    rest = text
    for c in SYMBOLS:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return F.octet_length(text) - F.octet_length(rest)


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: without_white_space(x) != "")
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def counted(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target): n-grams of all ``docs``, and of those whose id ``trusted`` (doc_id) has. Tasks pass on one row a bucket."""
    ids = trusted.select("doc_id").filter("doc_id IS NOT NULL").distinct().withColumn("trusted", F.lit(1))
    small = is_small(ids.select("doc_id"), TRUSTED_IDS)
    rows = docs.select(docs[id_col].alias("doc_id"), text_or_empty(docs[text_col]).alias("text")).join(F.broadcast(ids) if small else ids, "doc_id", "left")
    each = rows.select("trusted", F.explode(ngrams(words(F.col("text")), buckets)).alias("bucket"))
    return each.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, prior: int = PRIOR, unit_bits: int = UNIT_BITS) -> list[int]:
    """Per bucket log(target share / raw share) in units of 2^-``unit_bits``, the target with ``prior`` n-grams of the raw corpus added.

    The driver sees one row a bucket. Without a trusted n-gram all ratios are zero, as is that of a bucket that no text has.
    """
    found = {r["bucket"]: (r["raw"], r["target"]) for r in counts.collect()}
    raw, target = (sum(x[k] for x in found.values()) for k in (0, 1))
    out = [0] * buckets
    for b, (r, t) in found.items() if target else ():
        out[b] = round(math.log((float(t) * raw / r + prior) / (target + prior)) * (1 << unit_bits))
    return out


def quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_ratio).

    The target's multinomial is that of the documents whose id ``trusted`` has, the raw one that of all; both are over hashed words and pairs of words, repeats
    included. log_ratio is the mean over a text's n-grams of log(target / raw). A text is kept if it passes the base rules (ten words or more, at
    most a fifth of them in repeated windows) and its mean is at least ``threshold``. The same text always gets the same verdict.

    Null text counts as empty; a text without a word has no mean (null) and fails. Without trusted documents the base rules decide.
    Repeated rows each give theirs, null ids are kept and are never trusted, an empty table gives an empty result. Extra columns are not read.
    """
    weights = log_ratios(cut(counted(docs, trusted, id_col, text_col, buckets)), buckets)
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")  # folded into one constant
    text = F.col("text")
    rows = docs.select(docs[id_col].alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    facts = rows.select(
        "doc_id",
        F.length(without_white_space(text)).cast("long").alias("word_chars"),
        symbols(text).cast("long").alias("n_symbols"),
        repeated_lines(text).cast("long").alias("n_dup_lines"),
        _let(words(text), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), repeated_words(ws).cast("long").alias("n_repeat_words"), _total(ws, table, buckets).alias("total"))).alias("of"),
    )
    facts = facts.select("doc_id", "of.*", "word_chars", "n_symbols", "n_dup_lines")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    grams = 2 * F.col("n_words") - 1
    limit = F.lit(round(threshold * (1 << UNIT_BITS))).cast("long")
    mean = F.when(F.col("n_words") > 0, F.col("total").cast("double") / grams / float(1 << UNIT_BITS))
    return facts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("total") >= limit * grams)).alias("kept"), mean.alias("log_ratio"))


def _total(ws: Column, table: Column, buckets: int) -> Column:
    return F.aggregate(ngrams(ws, buckets), F.lit(0).cast("bigint"), lambda s, b: s + F.element_at(table, (b + 1).cast("int")))


def trusted_documents(labels: DataFrame) -> DataFrame:
    """(doc_id): documents labelled as good and not toxic; a missing label of toxicity counts as not."""
    return labels.filter("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0),
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS tab),
each AS (SELECT r, i, ws[i] AS word FROM w, range(1, len(ws) + 1) t(i)),
known AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(strlen(word)), lambda k: CAST('0x' || substr(hex(encode(word)), CAST(2 * k + 1 AS INTEGER), 2) AS BIGINT))),
    lambda x, b: xor(x >> 8, tab[xor(x & 255, b) + 1]))) AS h FROM (SELECT DISTINCT word FROM each), crc),
hashed AS (SELECT r, i, h, lead(h) OVER (PARTITION BY r ORDER BY i) AS h2 FROM each JOIN known USING (word)),
grams AS (SELECT r, h % {BUCKETS} AS b FROM hashed UNION ALL SELECT r, (h * {FACTOR} + h2) % {BUCKETS} FROM hashed WHERE h2 IS NOT NULL),
counts AS (SELECT b, count(*) AS raw, count(good.doc_id) AS target FROM grams JOIN w USING (r) LEFT JOIN good USING (doc_id) GROUP BY b),
sums AS (SELECT sum(raw) AS raws, sum(target) AS targets FROM counts),
weights AS (SELECT b, CASE WHEN targets = 0 THEN 0 ELSE CAST(round(ln((CAST(target AS DOUBLE) * raws / raw + {PRIOR}) / (targets + {PRIOR})) * {1 << UNIT_BITS}) AS BIGINT) END AS weight FROM counts, sums),
total AS (SELECT r, sum(weight) AS total FROM grams JOIN weights USING (b) GROUP BY r),
wins AS (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM (SELECT r, i, ws[i:i + {WINDOW_WORDS - 1}] AS win FROM w, range(1, len(ws) - {WINDOW_WORDS - 2}) t(i))),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW_WORDS})) AS p FROM wins WHERE n > 1) GROUP BY r),
facts AS (
  SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(total, 0) AS BIGINT) AS total
  FROM w LEFT JOIN rep USING (r) LEFT JOIN total USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND total >= {round(THRESHOLD * (1 << UNIT_BITS))} * (2 * n_words - 1) AS kept,
  CASE WHEN n_words > 0 THEN CAST(total AS DOUBLE) / (2 * n_words - 1) / {1 << UNIT_BITS} END AS log_ratio
FROM facts
"""
