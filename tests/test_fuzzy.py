"""Terms within a few edits against comparing all pairs."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from veriframe.operators import fuzzy


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def allowed(a):
    return 0 if len(a) < 3 else 1 if len(a) < 6 else 2


def shortened(p, d):
    out = {p}
    for _ in range(d):
        out |= {x[:i] + x[i + 1 :] for x in out for i in range(len(x))}
    return {x for x in out if len(x) >= fuzzy.LEAST}


@settings(max_examples=600, deadline=None)
@given(st.text("ab", min_size=3, max_size=14), st.lists(st.tuples(st.integers(0, 20), st.sampled_from("ids"), st.sampled_from("abc")), max_size=2))
def test_near_terms_share_a_variant_of_their_beginnings(a, changes):
    b = a
    for at, kind, c in changes:
        at %= len(b) + 1
        b = b[:at] + {"i": c + b[at:], "d": b[at + 1 :], "s": c + b[at + 1 :]}[kind]
    if distance(a, b) <= allowed(a):
        d = allowed(a)
        assert shortened(a[: fuzzy.PREFIX], d) & shortened(b[: fuzzy.PREFIX], 2 if len(b) >= fuzzy.TWO_EDITS - 2 else 1)


def test_against_all_pairs(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choices("abé", k=rng.randint(1, 12))) for _ in range(500)} | {"x" * 5000, "x" * 4999})
    asked = sorted(set(rng.sample(words, 60)) | {"a", "zz", "nothinglikeit", "x" * 5000})
    vocabulary = spark.createDataFrame([(w,) for w in words], "token string")
    got = fuzzy.near_terms(spark.createDataFrame([(w,) for w in asked], "asked string"), vocabulary).collect()
    short = [w for w in words if len(w) < 100]
    want = {(a, w, d) for a in asked if len(a) < 100 for w in short if (d := distance(a, w)) <= allowed(a)} | {("x" * 5000, "x" * 5000, 0), ("x" * 5000, "x" * 4999, 1)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_variants_are_few_whatever_the_length(spark):
    df = spark.createDataFrame([("abcdefghijklmnop" * 100,), ("",), ("a",), (None,)], "t string")
    sizes = [r.n for r in df.select(F.size(fuzzy.variants(F.col("t"), F.lit(2))).alias("n")).collect()]
    assert sizes[0] == 37 and sizes[1] == sizes[2] == 0


def test_queries_are_expanded_and_nothing_is_compared_in_a_product(spark):
    wanted = spark.createDataFrame([("q", "hello"), ("q", "hallo"), ("r", "no")], "query_id string, token string")
    vocabulary = spark.createDataFrame([("hello",), ("hullo",), ("no",), ("not",)], "token string")
    got = fuzzy.expanded(wanted, vocabulary)
    assert sorted(map(tuple, got.collect())) == [("q", "hello"), ("q", "hullo"), ("r", "no")]
    plan = fuzzy.near_terms(wanted.selectExpr("token AS asked"), vocabulary)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_beginnings_meet_by_hashes_as_joined_variants_do(spark, monkeypatch):
    """Also terms of one plane and the other, shorter than what may be left out, and none; no row of the vocabulary is multiplied in a plan."""
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abé\U0001f600", k=rng.randint(1, 11))) for _ in range(300)} | {"", "\x00ab"})
    vocabulary = spark.createDataFrame([(w,) for w in [*words, None]], "token string")
    asked = spark.createDataFrame([(w,) for w in rng.sample(words, 80)], "asked string")
    held, none = fuzzy.near_terms(asked, vocabulary), fuzzy.near_terms(asked.limit(0), vocabulary)
    assert "Generate" not in held._jdf.queryExecution().executedPlan().toString() and none.count() == 0
    monkeypatch.setattr(fuzzy, "HELD", 10)
    joined = fuzzy.near_terms(asked, vocabulary)
    assert "Generate" in joined._jdf.queryExecution().executedPlan().toString()
    rows = sorted(map(tuple, held.collect()))
    assert len(rows) > 100 and rows == sorted(map(tuple, joined.collect()))
