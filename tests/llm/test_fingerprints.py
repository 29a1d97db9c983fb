import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from veriframe.llm import fingerprints as fp


def hashes(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text.lower()).split(" ") if w]
    if not words:
        return set()

    def one(values):  # XXH64 of longs, chained by seed
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), seed=seed)
        return seed >> 64 - fp.BITS

    each = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]
    return {one(each[i : i + 5]) for i in range(max(1, len(each) - 4))}


def kept(text):
    """(level, hashes): the greatest fraction of the ladder that a text of so many shingles may have."""
    h = hashes(text)
    level = 0
    while level < fp.LEVELS and len(h) >= fp.EXPECTED << level + 1:
        level += 1
    return level, sorted(x for x in h if x < 1 << fp.BITS - level)


def written(text):
    level, found = kept(text)
    return str(level) + "".join(f"{h:08x}" for h in found)


def estimate(a, b):
    (i, x), (j, y) = kept(a), kept(b)
    x, y = ({h for h in s if h < 1 << fp.BITS - max(i, j)} for s in (x, y))
    return len(x & y) / len(x | y) if x | y else 1.0


def texts():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    out = {i: " ".join(rng.choices(words, k=rng.choice([0, 1, 4, 6, 50, 900]))) for i in range(40)}
    out |= {50: None, 51: "", 52: " \n", 53: "é" * 7, 54: "one two three four", 60: out[10], 61: "lang " * 20_000}
    return out


def test_report_against_brute_force(spark):
    docs = texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs.items()], "doc_id long, text string, block string")
    got = {r.doc_id: r for r in fp.fingerprint_report(df).collect()}
    order = sorted(docs, reverse=True)
    assert set(got) == set(docs)
    for k, i in enumerate(order):
        text, after = docs[i] or "", docs[order[(k + 1) % len(order)]] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == written(text)
        assert got[i].edited_fingerprint == written(edited)
        for near, other in ((got[i].near_edited, edited), (got[i].near_next, after)):
            a, b = hashes(text), hashes(other)
            exact = len(a & b) / len(a | b) if a | b else 1.0
            assert near == estimate(text, other) and abs(near - exact) < 0.25
            if max(len(a), len(b)) < 2 * fp.EXPECTED:
                assert near == exact


def test_containment_and_merge(spark):
    rng = random.Random(1)
    long = [f"w{rng.randrange(9999)}" for _ in range(4000)]
    rows = [(" ".join(long), " ".join(long[500:900]))]
    a, b = fp.sketch(F.col("a")), fp.sketch(F.col("b"))
    df = spark.createDataFrame(rows, "a string, b string")
    r = df.select(fp.containment(b, a).alias("inside"), fp.containment(a, b).alias("outside"), (fp.merge(a, b) == a).alias("absorbed"), F.size(a["hashes"]).alias("n")).first()
    assert r.inside > 0.95 and abs(r.outside - 0.1) < 0.07 and r.absorbed and 32 < r.n < 96
    halves = spark.createDataFrame([(" ".join(long[:2000]), " ".join(long[1996:]), " ".join(long))], "a string, b string, c string")
    both, whole = halves.select(fp.merge(a, b), fp.sketch(F.col("c"))).first()
    assert (both.level, whole.level) == (5, 6) and whole.hashes == [h for h in both.hashes if h < 1 << fp.BITS - 6]
    assert both.hashes == sorted(h for h in hashes(rows[0][0]) if h < 1 << fp.BITS - 5)


def test_error_over_a_corpus(spark):
    """Figures that the README gives: the mean and the 95th percentile of the error, and the share of a text that its fingerprint takes."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    order, errors, size = sorted(docs, reverse=True), [], 0
    for i, j in zip(order, [*order[1:], order[0]]):
        cut = len(docs[i]) // 3
        edited = docs[i][: len(docs[i]) - cut] + docs[j][:cut]
        for other in (edited, docs[j]):
            a, b = hashes(docs[i]), hashes(other)
            errors.append(abs(estimate(docs[i], other) - (len(a & b) / len(a | b) if a | b else 1.0)))
        size += len(written(docs[i]))
    errors.sort()
    print("mean", sum(errors) / len(errors), "p95", errors[int(0.95 * len(errors))], "size", size / sum(map(len, docs.values())))
    assert sum(errors) / len(errors) < 0.04 and errors[int(0.95 * len(errors))] < 0.15 and size < 0.25 * sum(map(len, docs.values()))


def test_edges(spark):
    one = spark.createDataFrame([(5, "a b c d e f g")], "doc_id long, text string")
    assert fp.fingerprint_report(one).first().near_next == 1.0
    assert fp.fingerprint_report(one.limit(0)).collect() == []
    rows = spark.createDataFrame([(1, "x y"), (1, "x y"), (None, "z"), (None, None)], "doc_id long, text string")
    assert fp.fingerprint_report(rows).count() == 4
