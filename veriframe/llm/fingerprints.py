"""Document fingerprints by threshold-scaled sketches of shingle hashes, in DataFrame operations only."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.llm.common import WHITE_SPACE_RUN, shuffle_partitions, text_or_empty

SHINGLE_WORDS = 5
#: Hashes are the upper BITS bits of XXH64. A sketch keeps every one below a fixed fraction of their range: 1/64, or as many times twice
#: that as texts of fewer shingles need to expect EXPECTED hashes. The fraction is part of the sketch, as its level: 2^-level.
BITS = 32
LEVELS = 6
EXPECTED = 32
#: Blocks of consecutive ids for each shuffle partition.
BLOCKS_EACH = 4


def _once(value: Column, f) -> Column:
    """f(value) where ``value`` is evaluated once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def shingle_hashes(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """The distinct hashes of a text's word shingles; shorter texts are one shingle, texts without a word have none."""
    hashed = F.transform(F.filter(F.split(F.lower(text), WHITE_SPACE_RUN), lambda w: w != ""), lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - (words - 1), F.lit(1))), lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(h, i, words)), 64 - BITS))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(many))

    return _once(hashed, of)


def reach(s: Column) -> Column:
    """The bound below which a sketch has every hash of its text."""
    return F.lit(1 << BITS) / F.pow(F.lit(2.0), s["level"])


def sketch(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """(level, hashes): every hash below its level's fraction, sorted."""

    def level(h: Column) -> Column:
        return sum((F.when(F.size(h) >= EXPECTED << k, 1).otherwise(0) for k in range(1, LEVELS + 1)), F.lit(0)).cast("int")

    def keep(x: Column) -> Column:
        return F.struct(x["level"].alias("level"), _once(reach(x), lambda t: F.sort_array(F.filter(x["hashes"], lambda h: h < t))).alias("hashes"))

    return _once(_once(shingle_hashes(text, words), lambda h: F.struct(level(h).alias("level"), h.alias("hashes"))), keep)


def _shared(a: Column, b: Column, f) -> Column:
    """f(hashes of a, hashes of b), both cut to the range that both sketches cover."""
    bound = F.least(reach(a), reach(b))
    return _once(bound, lambda t: f(F.filter(a["hashes"], lambda x: x < t), F.filter(b["hashes"], lambda x: x < t)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts' shingle sets, 0 to 1; of two texts without a word it is 1."""

    def of(x: Column, y: Column) -> Column:
        return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(1.0)).cast("double")

    return _shared(a, b, of)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has, for texts of any two lengths; null if a has none in range."""
    return _shared(a, b, lambda x, y: F.try_divide(F.size(F.array_intersect(x, y)), F.size(x)).cast("double"))


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together, from their sketches alone, at the lesser of their fractions."""
    return F.struct(F.greatest(a["level"], b["level"]).alias("level"), _shared(a, b, lambda x, y: F.sort_array(F.array_union(x, y))).alias("hashes"))


def as_text(s: Column) -> Column:
    """The level's digit, then 8 lowercase hex digits for each hash, in order."""
    return F.concat(s["level"].cast("string"), F.lower(F.array_join(F.transform(s["hashes"], lambda x: F.lpad(F.hex(x), BITS // 4, "0")), "")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_chars, sketch) for every row, in one pass without a shuffle; null text counts as empty."""
    text = text_or_empty(docs[text_col])
    return docs.select(docs[id_col].alias("doc_id"), F.length(text).cast("long").alias("n_chars"), sketch(text, words).alias("sketch"))


def _blocks(docs: DataFrame, id_col: str, count: int) -> tuple[Column, list, list[int]]:
    """A column with each id's block, blocks in descending id order; each block's greatest id; the block before each.

    The driver gets ``count`` ids, whatever the number of rows.
    """
    ids = docs.select(docs[id_col].alias("doc_id"))
    shares = [k / count for k in range(1, count)]
    bounds = (ids.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * count)).alias("b")).first()["b"] if shares else None) or []
    bounds = sorted(set(bounds), reverse=True)
    step = isqrt(len(bounds)) + 1
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)] or [[]]
    key = F.col("doc_id")

    def passed(xs: list) -> Column:
        return F.size(F.filter(F.lit(xs), lambda b: b > key)) if xs else F.lit(0)

    if len(groups) > 1:  # two steps of about the root of the number of bounds
        coarse = passed([g[-1] for g in groups])
        nested = F.array(*(F.lit(g) for g in groups), F.array().cast("array<bigint>"))
        block = _once(coarse, lambda c: F.least(c * step + F.size(F.filter(F.element_at(nested, c + 1), lambda b: b > key)), F.lit(len(bounds))))
    else:
        block = passed(groups[0])
    block = F.when(key.isNull(), F.lit(len(bounds) + 1)).otherwise(block)
    heads = {r["block"]: r["head"] for r in ids.groupBy(block.alias("block")).agg(F.max("doc_id").alias("head")).collect()}
    filled = sorted(heads)
    before = {b: filled[k - 1] for k, b in enumerate(filled)}
    n = len(bounds) + 2
    return block, [heads.get(b) for b in range(n)], [before.get(b, 0) for b in range(n)]


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, next_text, mark, next_mark): each row beside the next one in descending id order, cyclically; marks are sketches.

    Texts are shuffled once, in blocks of consecutive ids of about equal counts; each block's first row is sent to the block before
    as well, so no second exchange is needed where blocks meet.
    """
    parts = shuffle_partitions(docs.sparkSession)
    block, heads, before = _blocks(docs, id_col, BLOCKS_EACH * parts)
    kind = docs.schema[id_col].dataType
    rows = docs.select(docs[id_col].alias("doc_id"), text_or_empty(docs[text_col]).alias("text")).withColumn("block", block)
    at = F.col("block") + 1
    leads = F.col("doc_id").eqNullSafe(F.element_at(F.array(*(F.lit(h).cast(kind) for h in heads)), at))
    own = F.struct(F.col("block").alias("block"), F.lit(False).alias("guest"))
    guest = F.struct(F.element_at(F.lit(before), at).alias("block"), F.lit(True).alias("guest"))
    placed = rows.withColumn("to", F.explode(F.when(leads, F.array(own, guest)).otherwise(F.array(own)))).select("doc_id", "text", "to.block", "to.guest")
    marked = placed.repartition(parts, "block").withColumn("mark", sketch(F.col("text")))
    order = Window.partitionBy("block").orderBy("guest", F.desc_nulls_last("doc_id"), "text")
    return marked.withColumns({"next_text": F.lead("text").over(order), "next_mark": F.lead("mark").over(order)}).filter(~F.col("guest"))


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last floor(n_chars / 3) code points replaced by as many (or all) first ones of the next
    document in descending id order; after the last comes the first. Null text counts as empty. Texts without a word have the
    fingerprint "0", and are like each other (1) and nothing else (0). Texts of fewer than 64 shingles keep them all, so likeness between
    them is exact; ids are numbers. Null ids come last, repeated ids in the order of their texts. A
    table of one row is its own next. An empty table gives an empty result. Extra columns are not read.
    """
    n, cut = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    rows = with_next(docs, id_col, text_col).select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "mark", "next_mark")
    rows = rows.withColumn("edited_mark", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("mark")).alias("fingerprint"),
        as_text(F.col("edited_mark")).alias("edited_fingerprint"),
        likeness(F.col("mark"), F.col("edited_mark")).alias("near_edited"),
        likeness(F.col("mark"), F.col("next_mark")).alias("near_next"),
    )
