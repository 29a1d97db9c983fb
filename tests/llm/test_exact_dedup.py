import hashlib
import random

from pyspark.sql import functions as F

from veriframe.llm import exact_dedup

BLANK = " \t\n\x0b\x0c\r"


def brute(rows):
    norm = ["".join(c for c in t or "" if c not in BLANK) for _, t in rows]
    out = []
    for (i, t), n in zip(rows, norm):
        same = [(-len(u or ""), j) for (j, u), m in zip(rows, norm) if m == n]
        out.append((i, min(same)[1], len(same), i == min(same)[1], hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices("ab \n\t é", k=rng.randint(0, 4)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "\x0b\x0c\r"), (303, "\x1c"), (304, "x" * 200_000), (305, "x " * 200_000)]
    df = spark.createDataFrame([(i, t, i, "n") for i, t in rows], "doc_id long, text string, kept long, norm string")
    assert result(exact_dedup.exact_dedup(df)) == brute(rows)
    kept = exact_dedup.keep_first(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, *_, k, _ in brute(rows) if k) and kept.columns == df.columns


def test_one_huge_group_is_spread(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "if(id = 7, 'same  text', 'same text') AS text", "id AS salt", "id AS run", "id AS row")
    got = exact_dedup.exact_dedup(df).collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(7, 3000)} and [r.doc_id for r in got if r.kept] == [7] and len(got) == 3000
    assert [tuple(r) for r in exact_dedup.keep_first(df).collect()] == [(7, "same  text", 7, 7, 7)]


def test_neighbours_decide_and_not_the_hash(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices("ab ", k=rng.randint(0, 5)))) for i in range(400)] + [(400 + i, "x" * 50 + str(i % 3)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot_rows in (5, 10_000):  # every text has the same hash; spread over ranges, and not
        one = exact_dedup.exact_dedup(df, hashed=lambda norm: F.lit(0).cast("long"), hot_rows=hot_rows)
        assert result(one) == brute(rows)


def test_groups_come_from_one_range_sort(spark, capsys):
    df = spark.createDataFrame([(1, "a"), (2, "a ")], "doc_id long, text string")
    exact_dedup._sorted(df, "doc_id", "text", F.xxhash64, 512)
    plans = []
    keep, exact_dedup.cut = exact_dedup.cut, lambda d: (plans.append(d._jdf.queryExecution().executedPlan().toString()), keep(d))[1]
    try:
        exact_dedup.exact_dedup(df).collect()
    finally:
        exact_dedup.cut = keep
    assert "rangepartitioning(head" in plans[1] and "hashpartitioning" not in plans[1] and plans[1].count("Sort [") == 1


def test_repeated_rows_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a "), (None, "a"), (None, "b")], "doc_id long, text string")
    rows = exact_dedup.exact_dedup(df).collect()
    assert sum(r.kept for r in rows if r.group_size == 4) == 1 and all(r.keep_id == 1 for r in rows if r.group_size == 4)
    assert sorted((r.doc_id or 0, r.text) for r in exact_dedup.keep_first(df).collect()) == [(0, "b"), (1, "a ")]
    assert exact_dedup.exact_dedup(df.limit(0)).collect() == []


def test_rows_of_one_id_are_spread(spark, monkeypatch):
    cuts, keep = [], exact_dedup.cut
    monkeypatch.setattr(exact_dedup, "cut", lambda d: (cuts.append(d), keep(d))[1])
    for id_ in ("5L", "CAST(NULL AS BIGINT)"):
        cuts.clear()
        df = spark.range(100_000).selectExpr(f"{id_} AS doc_id", "'same text' AS text")
        rows = exact_dedup.exact_dedup(df)
        (r,) = rows.groupBy("keep_id", "group_size").agg(F.count("*").alias("rows"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()
        assert (r.keep_id, r.group_size, r.rows, r.kept) == (5 if id_ == "5L" else None, 100_000, 100_000, 1)
        assert cuts[1].groupBy("head", "hash", "salt").count().agg(F.max("count")).first()[0] <= 2 * exact_dedup.HOT_ROWS
        assert exact_dedup.keep_first(df).count() == 1
