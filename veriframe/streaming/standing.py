"""Standing results over a stream of document versions: document frequencies, and what the documents say of standing claims.

The state of a document is its last version and what that contributes. A newer version takes the old contributions back; an older one, which is late, changes
nothing. So the sums are those of the newest versions alone, whatever the order of the micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veriframe.functions import text as T
from veriframe.operators.joins import broadcast_if_small

KINDS = ("token", "supports", "refutes")
#: Standing claims of one stream, which are part of its plan.
MOST_CLAIMS = 1000
_OUT = "kind string, key string, delta long"
_STATE = "version long, tie long, kinds array<string>, keys array<string>"


def contributions(documents: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """(document_id, version, parts): what a version of a document (document_id, version, text) adds, as an array of (kind, key).

    A document counts once for each of its tokens, and once for each claim (assertion_id, subject, relation, object, polarity) whose three parts it holds, as
    support or, beside a negation or for a claim that must not hold, as refutation.
    """
    text = F.coalesce("text", F.lit(""))
    tokens = F.transform(T.tokens(text), lambda t: F.struct(F.lit("token").alias("kind"), t.alias("key")))
    if claims is None:
        return documents.select("document_id", "version", tokens.alias("parts"))
    parts = [T.normalise(F.col(c)).alias(c) for c in ("subject", "relation", "object")]
    listed = claims.select("assertion_id", *parts, (F.col("polarity") == "must_not_hold").alias("against")).limit(MOST_CLAIMS + 1).collect()
    if len(listed) > MOST_CLAIMS:
        raise ValueError(f"more than {MOST_CLAIMS} standing claims; split them over several streams")
    rows = documents.select("document_id", "version", tokens.alias("tokens"), T.normalise(text).alias("normal"))
    asked = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in c.asDict().items())) for c in listed))
    if not listed:
        return rows.select("document_id", "version", F.col("tokens").alias("parts"))
    holds = lambda c: F.aggregate(F.array(c["subject"], c["relation"], c["object"]), F.lit(True), lambda s, p: s & (p != "") & F.contains(F.col("normal"), p))
    kind = lambda c: F.when(c["against"] | T.any_of(F.col("normal"), T.NEGATIONS), "refutes").otherwise("supports")
    said = F.transform(F.filter(asked, holds), lambda c: F.struct(kind(c).alias("kind"), c["assertion_id"].alias("key")))
    return rows.select("document_id", "version", F.concat("tokens", said).alias("parts"))


def _rows(parts: DataFrame) -> DataFrame:
    """Contributions as the state keeps them; ``tie`` decides between different texts of one version."""
    name = lambda c: F.transform("parts", lambda p: p[c])
    return parts.filter("document_id IS NOT NULL AND version IS NOT NULL").select("document_id", "version", F.xxhash64("parts").alias("tie"), name("kind").alias("kinds"), name("key").alias("keys"))


def _moved(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The deltas by which a document's new versions, if one is the newest yet, change the sums."""
    old = state.get if state.exists else None
    best = old
    for b in batches:
        for row in b.itertuples(index=False):
            if best is None or (row.version, row.tie) > (best[0], best[1]):
                best = (int(row.version), int(row.tie), list(row.kinds), list(row.keys))
    if best is old or best is None:
        return
    state.update(best)
    before, after = (set(zip(x[2], x[3])) if x else set() for x in (old, best))
    moved = [(*k, -1) for k in before - after] + [(*k, 1) for k in after - before]
    yield pd.DataFrame(moved, columns=["kind", "key", "delta"])


def deltas(documents: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """(kind, key, delta) of a stream of document versions; a state of one document is bounded by its text."""
    return _rows(contributions(documents, claims)).groupBy("document_id").applyInPandasWithState(_moved, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def keep_standing(documents: DataFrame, path: str, checkpoint: str, claims: DataFrame | None = None) -> StreamingQuery:
    """Keep the sums of a stream under ``path``: each micro-batch writes its own folder, anew if it is run again after a failure."""

    def batch(df: DataFrame, number: int) -> None:
        df.groupBy("kind", "key").agg(F.sum("delta").alias("delta")).filter("delta <> 0").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return deltas(documents, claims).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def standing(sums: DataFrame) -> DataFrame:
    """(kind, key, n): the standing numbers from ``path``'s folders, read as one table."""
    return sums.groupBy("kind", "key").agg(F.sum("delta").alias("n")).filter("n <> 0")


def standing_of(documents: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """The same from all versions at once, as a batch plan: only the newest version of each document counts."""
    newest = _rows(contributions(documents, claims)).groupBy("document_id").agg(F.max_by(F.struct("kinds", "keys"), F.struct("version", "tie")).alias("x"))
    return newest.select(F.explode(F.arrays_zip("x.kinds", "x.keys")).alias("p")).groupBy(F.col("p.kinds").alias("kind"), F.col("p.keys").alias("key")).agg(F.count("*").alias("n"))


def verdicts(claims: DataFrame, numbers: DataFrame) -> DataFrame:
    """(assertion_id, supports, refutes, label): each claim's standing documents and what they come to."""
    said = numbers.filter(F.col("kind") != "token").groupBy("key").pivot("kind", list(KINDS[1:])).agg(F.sum("n"))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = claims.select("assertion_id").join(broadcast_if_small(said), F.col("assertion_id") == F.col("key"), "left").select("assertion_id", n("supports"), n("refutes"))
    label: Column = F.when((F.col("supports") > 0) & (F.col("refutes") > 0), "mixed").when(F.col("supports") > 0, "supported").when(F.col("refutes") > 0, "contradicted").otherwise("unknown")
    return rows.withColumn("label", label)
