"""Which of many strings are in a text: one automaton over the strings runs once over each text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from veriframe.sources.shared import cut

#: Patterns that one automaton holds, at most, in number and in bytes; more of them are dealt to several automata.
BLOCK_PATTERNS, BLOCK_BYTES = 100_000, 8 << 20


def automaton(patterns: list[str]):
    """The automaton of some patterns; each is its own value."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for p in patterns:
        found.add_word(p, p)
    found.make_automaton()
    return found


def contained(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, pattern): each pattern (column pattern) that the text of a row (id, text) contains, once a row.

    Patterns are dealt by hash to blocks of a bounded size; a block's automaton goes to all tasks, and every text is read once for each block, however many
    patterns it has. Null texts and patterns match nothing; the empty pattern is in every text.
    """
    own = cut(patterns.select("pattern").filter("pattern IS NOT NULL").distinct())
    size = own.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0)).alias("bytes"), F.count_if(F.col("pattern") == "").alias("empty")).first()
    kind = texts.schema["id"].dataType.simpleString()
    rows = texts.select("id", "text").filter("text IS NOT NULL")
    blocks = max(-(-size["n"] // BLOCK_PATTERNS), -(-size["bytes"] // BLOCK_BYTES), 1)
    found = rows.select("id", F.lit("").alias("pattern")) if size["empty"] else rows.limit(0).select("id", F.col("text").alias("pattern"))
    for b in range(blocks):
        held = [r["pattern"] for r in own.filter((F.col("pattern") != "") & (F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == b)).collect()]
        if held:
            found = found.unionByName(rows.mapInArrow(_search(texts.sparkSession.sparkContext.broadcast(held)), f"id {kind}, pattern string"))
    return found


def _search(shared):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = None
        for b in it:
            search = search or automaton(shared.value).iter  # once a task; a task without rows needs none
            row, hits = [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                of = {p for _, p in search(text)}
                hits += of
                row += [k] * len(of)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(hits, pa.string())], ["id", "pattern"])

    return batches


def with_groups(df: DataFrame, text: Column, groups: list[tuple[str, ...]], name: str) -> DataFrame:
    """``df`` with a column ``name``: the numbers, ascending, of the groups of patterns of which ``text`` contains one.

    The automaton is part of the tasks: groups are rules, not a table. Null texts have none.
    """
    of: dict[str, list[int]] = {}
    for k, patterns in enumerate(groups):
        for p in patterns:
            of.setdefault(p, []).append(k)
    always = set(of.pop("", ()))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = automaton(list(of)).iter if of else lambda _: ()
        for b in it:
            found = [None if t is None else sorted(always.union(*(of[p] for p in {p for _, p in search(t)}))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], ["row", "hits"])

    rows = df.select(F.struct("*").alias("row"), text.alias("text"))
    out = rows.mapInArrow(batches, StructType([rows.schema["row"], StructField("hits", ArrayType(IntegerType()))]))
    return out.select("row.*", F.coalesce("hits", F.array().cast("array<int>")).alias(name))
