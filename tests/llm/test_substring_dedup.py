import random
import time

import numpy as np

from veriframe.llm import substring_dedup as sd


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n))


def test_gear_hash_against_definition():
    data = np.frombuffer(bytes(random.Random(1).choices(range(256), k=200)), np.uint8)
    want = [sum(int(sd.GEAR[data[i - k]]) << sd.STEP * k for k in range(min(sd.WINDOW, i + 1))) % 2**32 for i in range(200)]
    assert sd.gear_hash(data).tolist() == want


def test_chunks_resist_shifts_and_cover_all():
    rng = random.Random(2)
    text = words(rng, 2000).encode()
    parts = {sd.chunks_of([t])[5].tobytes(): t for t in (text, b"some inserted words " + text)}
    a, b = (set(np.frombuffer(k, np.int64).tolist()) for k in parts)
    assert len(a & b) > 0.98 * len(a)
    doc, word, count, start, size, *_ = sd.chunks_of([b"", text, b"x"])
    assert doc.tolist() == [1] * (len(doc) - 1) + [2] and count.sum() == 2001
    assert (word[1:-1] == (word + count)[:-2]).all()
    assert [text[i : i + n].split()[0] for i, n in zip(start[:-1], size[:-1])] == [text.split()[k] for k in word[:-1]]


def test_batching_changes_nothing():
    rng = random.Random(3)
    texts = [words(rng, rng.randint(0, 80)).encode() for _ in range(20)]
    together = sd.chunks_of(texts)
    alone = [sd.chunks_of([t]) for t in texts]
    for k in range(1, 7):
        assert together[k].tolist() == [x for a in alone for x in a[k].tolist()]


def test_planted_passages(spark):
    rng = random.Random(4)
    passages = [words(rng, 55) for _ in range(6)]
    short = words(rng, 15)
    rows, hit = [], set()
    for i in range(120):
        text = words(rng, rng.randint(20, 200))
        if i % 4 == 0:
            text += " " + passages[i % 6] + "\n" + words(rng, 30)
            hit.add(i)
        elif i % 4 == 1:
            text = words(rng, 10) + " " + short + " " + text
        rows.append((i, text, 0))
    rows += [(200, None, 0), (201, "", 0), (202, "z" * 100_000, 0), (None, passages[0], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    spans = sd.repeated_spans(df)
    found = spans.collect()
    assert {r.doc_id for r in found} == hit
    by = {r[0]: r[1] for r in rows}
    for r in found:
        piece = by[r.doc_id].encode()[r.start : r.start + r.size].decode()
        assert len(piece.split()) == r.words and piece in by[r.first_doc_id].replace("\n", "\n")
        assert r.kept == (r.doc_id == r.first_doc_id)
    clean = {r.doc_id: r.text for r in sd.remove_spans(df, spans).collect()}
    assert len(clean) == len(by) and all(clean[i] == by[i] for i in clean if i not in hit)
    assert sum(p in clean[i] for p in passages for i in hit) == sum(1 for _ in {i % 6 for i in hit})


def test_repeated_rows_and_empty(spark):
    text = words(random.Random(5), 100)
    df = spark.createDataFrame([(1, text), (1, text), (2, "other words")], "doc_id long, text string")
    assert sd.repeated_spans(df).collect() == []
    twice = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.kept) for r in sd.repeated_spans(twice).collect()) == [(1, True), (2, False)]
    assert sd.repeated_spans(df.limit(0)).collect() == []


def test_any_fifty_words_share_an_anchor():
    rng = random.Random(6)
    texts = [words(rng, 50) for _ in range(300)] + ["ab cd " * 25, "la " * 50, "one two three four five six seven " * 7 + "one"]
    for text in texts:
        a, b = (set(sd.anchors_of([f"{words(rng, 30)} {text} {words(rng, 40)}".encode()])[5].tolist()) for _ in range(2))
        assert a & b


def test_unspaced_periodic_and_within_one_document(spark):
    rng = random.Random(7)
    han = lambda n: "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(n))
    code = lambda n: "".join(rng.choices("abcdef(){};=.,", k=n))
    passage, script, twice = han(300), code(400), words(rng, 60)
    periodic = "tick tock " * 40
    rows = [(1, han(200) + passage + han(150)), (2, han(90) + passage + han(333)), (3, code(300) + script + code(99)), (4, code(500) + script)]
    rows += [(5, f"{words(rng, 33)} {periodic}{words(rng, 21)}"), (6, f"{words(rng, 12)} {periodic}{words(rng, 17)}")]
    rows += [(7, f"{words(rng, 30)} {twice} {words(rng, 30)} {twice} {words(rng, 9)}"), (8, words(rng, 200)), (9, han(800)), (10, code(3000))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = sd.repeated_spans(df)
    assert {r.doc_id for r in spans.collect()} == {1, 2, 3, 4, 5, 6, 7}
    before, after = dict(rows), {r.doc_id: r.text for r in sd.remove_spans(df, spans).collect()}
    assert all(before[i] == after[i] for i in (1, 3, 8, 9, 10))
    assert passage not in after[2] and len(before[2]) - 300 <= len(after[2]) < len(before[2]) - 150
    assert script not in after[4] and len(before[4]) - 400 <= len(after[4]) < len(before[4]) - 250
    assert after[7].count(twice) == 1 and after[7].index(twice) == before[7].index(twice)
    assert "tick tock" in after[5] and after[6].count("tick") < 40


def test_recall_and_coverage_by_length(spark):
    """Figures that the README gives: the share of passages found at all, and of their words, by length."""
    rng = random.Random(9)
    lengths = (20, 25, 30, 35, 40, 45, 50, 60, 100)
    planted = [(n, words(rng, n)) for n in lengths for _ in range(60)]
    rows = [(2 * k + side, f"{words(rng, 40)} {p} {words(rng, 40)}") for k, (_, p) in enumerate(planted) for side in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    covered = {r.doc_id: r.n for r in sd.repeated_spans(df).groupBy("doc_id").agg({"words": "sum"}).withColumnRenamed("sum(words)", "n").collect()}
    recall = {n: sum(2 * k + 1 in covered for k, (m, _) in enumerate(planted) if m == n) / 60 for n in lengths}
    share = {n: sum(covered.get(2 * k + 1, 0) for k, (m, _) in enumerate(planted) if m == n) / 60 / n for n in lengths}
    print({n: (round(recall[n], 2), round(share[n], 2)) for n in lengths})
    assert all(recall[n] == 1 for n in lengths if n >= 50) and recall[40] >= 0.9 and share[100] > 0.85


def test_removal_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "é one two three", "a", "b", "c"), (2, None, "a", "b", "c")], "doc_id long, text string, __id string, __cuts string, row string")
    spans = spark.createDataFrame([(1, 3, 4, False), (1, 11, 5, False), (1, 0, 2, True)], "doc_id long, start int, size int, kept boolean")
    assert sorted(tuple(r) for r in sd.remove_spans(df, spans).collect()) == [(1, "é two ", "a", "b", "c"), (2, None, "a", "b", "c")]


def test_texts_of_one_id_stay_apart(spark):
    rng = random.Random(3)
    p, q = (" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(80)) for _ in range(2))
    df = spark.createDataFrame([(1, p), (2, p), (2, q)], "doc_id long, text string")
    spans = sd.repeated_spans(df)
    left = sorted((r.doc_id, len(r.text.split())) for r in sd.remove_spans(df, spans).collect())
    assert left[0] == (1, 80) and left[2] == (2, 80) and left[1][1] < 20 and {r.text for r in sd.remove_spans(df, spans).collect()} >= {p, q}


def test_first_shuffle_is_deleted_before_the_second(spark):
    rng = random.Random(11)
    passage = words(rng, 60)
    df = spark.createDataFrame([(i, words(rng, 100) + " " + passage) for i in range(40)], "doc_id long, text string").repartition(4)

    def shuffled():
        held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {name for path in held.split("\n") if (name := path.rsplit("/", 1)[-1]).startswith("shuffle_")}

    before = shuffled()
    spans = sd.repeated_spans(df)
    end = time.time() + 20
    while shuffled() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled() - before
    assert {r.doc_id for r in spans.collect()} == set(range(40))
