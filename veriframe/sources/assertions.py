"""Assertions from the command-line forms, as expressions over a column of strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "pos int, line string")


def parse_triples(spark: SparkSession, texts: list[str]) -> DataFrame:
    """``subject|relation|object``: parts are trimmed, lines with fewer than three are skipped, ids count input positions."""
    parts = F.split("line", r"\|")
    rows = _lines(spark, texts).withColumn("p", parts).filter(F.size("p") >= 3)
    return rows.select(F.concat(F.lit("t"), F.col("pos").cast("string")).alias("assertion_id"), *(F.trim(F.col("p")[k]).alias(n) for k, n in enumerate(("subject", "relation", "object"))))


def parse_assertions(spark: SparkSession, texts: list[str]) -> DataFrame:
    """``subject|relation|object[|polarity]``: parts as they are, ids count the lines that are kept."""
    rows = _lines(spark, texts).withColumn("p", F.split("line", r"\|")).filter(F.size("p") >= 3)
    n = F.row_number().over(Window.orderBy("pos"))  # a command line's few assertions
    return rows.select(
        F.concat(F.lit("claim_"), n.cast("string")).alias("assertion_id"),
        *(F.col("p")[k].alias(name) for k, name in enumerate(("subject", "relation", "object"))),
        F.coalesce(F.get("p", 3), F.lit("must_hold")).alias("polarity"),
    )
