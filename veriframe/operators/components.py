"""Connected components of large graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.sources.shared import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node that has an edge to another, with the least node of its component, by alternating large-star and small-star steps.

    Self loops and null ends are ignored. The edges never grow in number, the rounds are logarithmic in practice, and two numbers a round
    reach the driver; every round is a stored table.
    """
    low, high = F.least(a, b).alias("v"), F.greatest(a, b).alias("u")
    links = cut(edges.filter(F.col(a) != F.col(b)).select(high, low).distinct())
    state = _state(links)
    while state[0]:
        links = cut(_small_star(_large_star(links)))
        before, state = state, _state(links)
        if state == before:
            break
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _large_star(links: DataFrame) -> DataFrame:
    """Greater neighbours of every node are linked to the least of itself and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its lesser neighbours are linked to the least of these."""
    least = cut(links.groupBy("u").agg(F.min("v").alias("m")))
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0
