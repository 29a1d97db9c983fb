"""Claims to verify: assertions from tables or strings, and those derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.functions import text as T

SCHEMA = "assertion_id string, subject string, relation string, object string, polarity string, rule_type string"


def with_defaults(assertions: DataFrame) -> DataFrame:
    """Assertions with polarity and rule_type where they are missing."""
    have = set(assertions.columns)
    polarity = F.coalesce(F.col("polarity"), F.lit("must_hold")) if "polarity" in have else F.lit("must_hold")
    rule = F.coalesce(F.col("rule_type"), F.lit("constraint")) if "rule_type" in have else F.lit("constraint")
    return assertions.select("assertion_id", "subject", "relation", "object", polarity.alias("polarity"), rule.alias("rule_type"))


def as_queries(assertions: DataFrame) -> DataFrame:
    """(query_id, query): a claim's parts, joined by spaces."""
    return assertions.select(F.col("assertion_id").alias("query_id"), F.concat_ws(" ", "subject", "relation", "object").alias("query"))


def claims(spark: SparkSession, documents: DataFrame, chunks: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Claims over the driver's tables: the first three tokens of each benchmark text, of each source's first chunk that
    holds "no ", and one claim whose tokens occur nowhere."""

    def parts(text: Column) -> list[Column]:
        found = T.all_tokens(text)
        return [F.get(found, k).alias(n) for k, n in enumerate(("subject", "relation", "object"))]

    common = benchmark.select(
        F.concat(F.lit("b"), F.format_string("%05d", F.col("item_id"))).alias("assertion_id"),
        *parts(F.col("text")),
        F.when(F.col("item_id") % 5 == 0, "must_not_hold").otherwise("must_hold").alias("polarity"),
    )
    sources = documents.select(F.col("doc_id").cast("string").alias("document_id"), "source")
    # "no " in a normalised text is "no", white space and more in the text
    lower = F.lower("text")
    negated = chunks.filter(F.contains(lower, F.lit("no")) & F.rlike(lower, F.lit(r"(?U)no\s+\S"))).join(sources, "document_id")
    first = negated.groupBy("source").agg(F.min_by("text", "chunk_id").alias("text"))
    other = first.select(F.concat(F.lit("n"), F.col("source")).alias("assertion_id"), *parts(F.col("text")), F.lit("must_hold").alias("polarity"))
    absent = spark.range(1).select(F.lit("u").alias("assertion_id"), F.lit("zzqx").alias("subject"), F.lit("zzqy").alias("relation"), F.lit("zzqz").alias("object"), F.lit("must_hold").alias("polarity"))
    every = common.unionByName(other).unionByName(absent)
    return every.select("assertion_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("subject", "relation", "object")), "polarity", F.lit("constraint").alias("rule_type"))
