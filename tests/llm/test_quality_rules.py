import math
import re
import zlib
from collections import Counter

import duckdb
import pytest
from veriframe.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, trusted):
    grams = {}
    for k, (_, t) in enumerate(rows):
        h = [zlib.crc32(w.encode()) for w in WORD.findall(t or "")]
        grams[k] = [x % q.BUCKETS for x in h] + [(a * q.FACTOR + b) % q.BUCKETS for a, b in zip(h, h[1:])]
    raw = Counter(b for g in grams.values() for b in g)
    target = Counter(b for k, g in grams.items() for b in g if rows[k][0] in trusted)
    r, t = sum(raw.values()), sum(target.values())
    weight = {b: round(math.log((float(target[b]) * r / n + q.PRIOR) / (t + q.PRIOR)) * (1 << q.UNIT_BITS)) if t else 0 for b, n in raw.items()}
    out = []
    for k, (i, text) in enumerate(rows):
        text = text or ""
        ws = WORD.findall(text)
        windows = [tuple(ws[j : j + 5]) for j in range(len(ws) - 4)]
        twice = {w for w, n in Counter(windows).items() if n > 1}
        inside = {p for j, w in enumerate(windows) if w in twice for p in range(j, j + 5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(ws) < 10 or 100 * len(inside) > 20 * len(ws)
        total = sum(weight[b] for b in grams[k])
        kept = not failed and total >= round(q.THRESHOLD * (1 << q.UNIT_BITS)) * (2 * len(ws) - 1)
        mean = total / (2 * len(ws) - 1) / (1 << q.UNIT_BITS) if ws else None
        out.append((i, len(ws), sum(map(len, ws)), sum(text.count(c) for c in q.SYMBOLS), len(lines) - len(set(lines)), len(inside), failed, kept, mean))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


PROSE = "the quick brown fox jumps over the lazy dog and then it walks home again under a pale moon"
ROWS = [
    (1, PROSE),
    (2, " | ".join(PROSE.split())),
    (3, "a b c d e a b c d e"),
    (4, "x x x x x x x x x x x x"),
    (5, "one\nline\none\n \nline\none two three four five six seven eight"),
    (6, None),
    (7, ""),
    (8, " \t\n\x0b\x0c\r "),
    (9, "é\x1cü\x85ö  #*$%&|<> ß"),
    (10, "a b c d"),
    (11, "w" * 100_000 + " end"),
    (12, " ".join(f"w{k % 977}" for k in range(50_000))),
    (None, PROSE),
    (2, PROSE + " #"),
    (2, PROSE + " #"),
    (13, "p q r s t u p q r s t v w x y z a b c d e f g h i j k l m n o p2 q2 r2 s2 t2 u2 v2 w2 x2 y2"),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, i, "n", True) for i, t in rows], "doc_id long, text string, bucket long, words string, trusted boolean")


def labels(spark, rows=((1, 1, 0), (1, 1, None), (2, 0, 0), (5, 1, 1), (None, 1, 0), (13, None, None))):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_against_brute_force(spark):
    assert result(q.quality(docs(spark), q.trusted_documents(labels(spark)))) == brute(ROWS, {1})


def test_shuffled_join_says_the_same(spark, monkeypatch):
    monkeypatch.setattr(q, "TRUSTED_IDS", 0)
    assert result(q.quality(docs(spark), q.trusted_documents(labels(spark)))) == brute(ROWS, {1})


def test_without_trusted_documents_the_base_rules_decide(spark):
    rows = q.quality(docs(spark), q.trusted_documents(labels(spark).limit(0))).collect()
    assert all(r.kept == (not r.base_failed) and not r.log_ratio for r in rows)


def test_unlike_texts_are_rejected_and_like_ones_kept(spark):
    prose = [(k, " ".join((PROSE.split() * 30)[k % 7 :][: 200 + k]) + f" n{k}") for k in range(300)]
    # windows repeat in them, so look at the ratio alone
    junk = [(1000 + k, " ".join(f"buy{k}x{j % 3} now!!" for j in range(200))) for k in range(60)]
    found = {r.doc_id: r.log_ratio for r in q.quality(docs(spark, prose + junk), labels(spark, [(k, 1, 0) for k in range(0, 300, 2)])).collect()}
    assert min(found[k] for k, _ in prose) > q.THRESHOLD > max(found[k] for k, _ in junk)


def test_empty_table(spark):
    assert q.quality(docs(spark).limit(0), q.trusted_documents(labels(spark))).collect() == []


def test_native(spark):
    plan = q.quality(docs(spark), q.trusted_documents(labels(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_oracle(spark, sf):
    con = duckdb.connect()
    for n in ("documents", "labels"):
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '/root/testdata/{sf}/{n}.parquet'")
    read = lambda n: spark.read.parquet(f"/root/testdata/{sf}/{n}.parquet")
    got = q.quality(read("documents"), q.trusted_documents(read("labels")))
    want = con.execute(q.ORACLE_SQL)
    assert [d[0] for d in want.description] == got.columns and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM (VALUES (1, NULL), (NULL, 'a b'), (2, 'x x x x x x'), (2, '')) t(doc_id, text)")
    small = spark.createDataFrame([(1, None), (None, "a b"), (2, "x x x x x x"), (2, "")], "doc_id long, text string")
    assert sorted(map(repr, map(tuple, q.quality(small, q.trusted_documents(read("labels"))).collect()))) == sorted(map(repr, con.execute(q.ORACLE_SQL).fetchall()))
