"""Shared pieces: table access, batches bounded in bytes, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veriframe.sources.shared import cut

#: The six bytes that the contracts call white space: space and \t \n \v \f \r.
WHITE_SPACE = " \t\n\x0b\x0c\r"
WHITE_SPACE_RUN = r"[\x20\x09-\x0D]+"
BATCH_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20
#: Keys of more rows than HOT_ROWS and than a HOT_KEYS-th of all are hot; there are fewer than HOT_KEYS of them, however large the table.
HOT_ROWS = 512
HOT_KEYS = 1 << 16

__all__ = ["components", "cut", "hot_from", "join_spread", "map_batches", "shuffle_partitions", "table", "text_or_empty", "without_white_space"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes: a batch of very long texts doesn't outgrow a worker. Sets the session's bound
    unless it has a smaller one."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_BOUND, None) or 0) <= BATCH_BYTES:
        conf.set(BATCH_BOUND, str(BATCH_BYTES))
    return df.mapInArrow(f, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def without_white_space(text: Column) -> Column:
    """Delete the six ASCII white-space bytes; plain byte replacement is several times faster than a pattern."""
    for c in WHITE_SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def hot_from(total: int, hot_rows: int = HOT_ROWS) -> int:
    """Keys of more rows than this, in a table of ``total`` rows, are hot."""
    return max(hot_rows, -(-total // HOT_KEYS))


def join_spread(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined to ``keyed`` on ``key``; keyed has a row for each key, and in ``count`` how many of the ``total`` rows have it.

    Hot keys, fewer than HOT_KEYS, are broadcast, so their rows stay where they are; only the others are shuffled. Both sides should be stored.
    """
    least = hot_from(total, hot_rows)
    hot = keyed.filter(F.col(count) > least)
    if hot.isEmpty():
        return rows.join(keyed.drop(count), key)
    hot = cut(hot.drop(count))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keyed.filter(F.col(count) <= least).drop(count), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star steps.

    Returns (node, root): every node that has an edge to another, with the smallest node of its component. Self loops and null ends
    are ignored; an empty edge table gives an empty result. The edge count never grows, the number of rounds is
    logarithmic in practice, every round is cut to the shared folder, and nothing but two numbers a round reaches the driver. The star of
    a root may hold a large share of all edges: aggregation combines it on the map side, and adaptive execution splits it in the joins.
    """
    low, high = F.least(a, b).alias("v"), F.greatest(a, b).alias("u")
    e = cut(edges.filter(F.col(a) != F.col(b)).select(high, low).distinct())
    mark = _checksum(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))  # cut, so that the join can be split
        large = cut(both.filter("v > u").join(nearest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lowest = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        linked = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(linked.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        before, mark = mark, _checksum(e)
        if before == mark:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _checksum(e: DataFrame) -> tuple[int, int]:
    row = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0
