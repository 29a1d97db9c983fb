"""Exact dedup by content sort, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.llm.common import HOT_ROWS, cut, hot_from, text_or_empty, without_white_space

#: Splitters compare this much of a normalised text, then its hash: the driver samples keys of bounded size.
PREFIX = 32


def _sorted(docs: DataFrame, id_col: str, text_col: str, hashed: Callable[[Column], Column], hot_rows: int) -> DataFrame:
    """(row, doc_id, n, sha, kept, keep_id, size): every row of ``docs`` as a struct, with what the content sort says of it."""
    norm = without_white_space(text_or_empty(docs[text_col]))
    count = docs.count()
    rows = docs.select(F.struct("*").alias("row"), docs[id_col].alias("doc_id"), F.substring(norm, 1, PREFIX).alias("head"), hashed(norm).alias("hash"))
    least = hot_from(count, hot_rows)
    hot = rows.groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n") > least).select("hash", F.ceil(F.col("n") / least).alias("parts"))
    # fewer than HOT_KEYS rows of two numbers
    # by the row's number, as a hot key's rows may share one id or be equal throughout
    salt = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("parts")), F.lit(-1).cast("long"))
    dealt = rows.join(F.broadcast(cut(hot)), "hash", "left").withColumn("salt", salt).drop("parts").repartitionByRange("head", "hash", "salt")
    text = text_or_empty(F.col("row")[text_col])
    dealt = dealt.withColumns({"norm": without_white_space(text), "n": F.length(text)})

    order = [F.desc("n"), F.asc_nulls_last("doc_id")]
    equal = Window.partitionBy("head", "hash", "salt", "norm").orderBy(*order)
    whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = dealt.withColumns({"first": F.row_number().over(equal) == 1, "keep_id": F.first("doc_id").over(whole), "size": F.count("*").over(whole)})
    number = Window.partitionBy("head", "hash", "salt").orderBy("norm", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = runs.withColumn("run", F.sum(F.col("first").cast("int")).over(number))
    spread = F.col("salt") >= 0
    placed = cut(runs.select("row", "doc_id", "n", F.sha2("norm", 256).alias("sha"), "first", "keep_id", "size", "head", "hash", "salt", "run", F.when(spread & F.col("first"), F.col("norm")).alias("norm")))
    result = ["row", "doc_id", "n", "sha", "kept", "keep_id", "size"]
    alone = placed.filter(~spread).withColumnRenamed("first", "kept").select(*result)
    if placed.filter(spread).isEmpty():
        return alone

    # the first rows of the ranges of a key, whole texts again, meet in a second sort: one row for each range
    key = ["head", "hash", "salt", "run"]
    heads = placed.filter(spread & F.col("first")).select(*key, "norm", "n", "doc_id", "size").repartitionByRange("head", "hash")
    met = Window.partitionBy("head", "hash", "norm").orderBy(*order, "salt")
    all_ = met.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = heads.select(*key, (F.row_number().over(met) == 1).alias("best"), F.first("doc_id").over(all_).alias("keep_id"), F.sum("size").over(all_).alias("size"))
    parts = placed.filter(spread).drop("keep_id", "size").join(cut(merged), key)
    return alone.unionByName(parts.withColumn("kept", F.col("first") & F.col("best")).select(*result))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: Callable[[Column], Column] = F.xxhash64, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per row of ``docs``: (doc_id, keep_id, group_size, kept, text_sha256, n_code_points).

    Texts are equal when identical once every ASCII white-space character is deleted. Of equal texts the one with the
    most code points stays, then the smallest id. Sampled splitters range-partition the normalised texts (their first characters, then
    ``hashed``), each partition is sorted externally by the whole normalised text, and neighbours are compared in full: the
    runs of equal ones are the groups. ``hashed`` only orders; texts that share it stay apart. Hot keys (``hot_from``) are spread over further ranges, of about as
    many rows as make a key hot, by a salt of the row's number; the first rows of these ranges meet in a second sort. The number is that within the row's
    partition, so ``docs`` must be read in the same order when a lost task runs again, as files and stored tables are; store first what comes out of a shuffle.

    Null text counts as empty, so null, empty and blank texts form one group. A null id sorts after every other id.
    Rows repeated with one id and text form a group in which exactly one row has kept = true. An empty table gives an
    empty result. Extra columns, whatever their names, are not read.
    """
    rows = _sorted(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), "doc_id", "text", hashed, hot_rows)
    return rows.select("doc_id", "keep_id", F.col("size").cast("long").alias("group_size"), "kept", F.col("sha").alias("text_sha256"), F.col("n").cast("long").alias("n_code_points"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: Callable[[Column], Column] = F.xxhash64, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows of ``docs``, whole, that ``exact_dedup`` keeps: one of each group of equal texts. Rows take part in the sort, so none is joined again."""
    return _sorted(docs, id_col, text_col, hashed, hot_rows).filter("kept").select("row.*")


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_code_points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT doc_id, n_code_points, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_code_points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256,
       CAST(n_code_points AS BIGINT) AS n_code_points
FROM g
"""
