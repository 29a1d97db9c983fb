"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veriframe.functions.text import all_tokens, stable_bucket

BUCKETS = 5


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def hashed_embedding(text: Column, buckets: int = BUCKETS) -> Column:
    """Token counts in hash buckets, scaled to length one (a zero vector stays), rounded to four places."""

    def scaled(counts: Column) -> Column:
        length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
        return F.transform(counts, lambda x: F.round(x / F.when(length == 0, F.lit(1.0)).otherwise(length), 4))

    def count(placed: Column, bucket: int) -> Column:
        return F.size(F.filter(placed, lambda x: x == bucket)).cast("double")

    placed = F.transform(all_tokens(text), lambda t: stable_bucket(t, buckets))
    counted = F.transform(F.array(placed), lambda p: F.array(*(count(p, k) for k in range(buckets))))
    return F.element_at(F.transform(counted, scaled), 1)
