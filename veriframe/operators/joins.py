"""Joins whose small side is checked before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.sources.shared import cut

#: A side is broadcast if it has at most this many rows and bytes; beyond that the join is left to the planner's shuffle.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20


def is_small(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``most`` rows that take at most ``most_bytes`` written as JSON; reads no more rows than tell."""
    size = df.limit(most + 1).agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")).first()
    return size["n"] <= most and (size["bytes"] or 0) <= most_bytes


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a look at up to ``most`` + 1 rows shows that it is small."""
    return F.broadcast(df) if is_small(df, most) else df


def broadcast_blocks(df: DataFrame, key: str, most: int) -> list[DataFrame]:
    """``df`` in broadcast blocks of about ``most`` rows, dealt by ``key``, for joins without an equality: every block meets all rows
    of the other side, and no product of two large tables is planned."""
    stored = cut(df)
    count = stored.count()
    if count <= most:
        return [F.broadcast(stored)]
    blocks = -(-count // most)
    return [F.broadcast(stored.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)) for b in range(blocks)]
