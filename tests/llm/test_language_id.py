import math
import random
import re
import zlib

import pytest

from veriframe.llm import language_id as li

WORDS = {"en": "the and ing tion ea th er re".split(), "de": "der und ung keit sch ei zu ver".split(), "fr": "le les eau eux é que ment oi".split()}


def longest_matches(text, train):
    count, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in train:
            size += 1
        at += size
        count += 1
    return count


def test_phrases_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        train = "".join(rng.choices("abc ", k=rng.randint(1, 60)))
        text = "".join(rng.choices("abcd ", k=rng.randint(0, 40)))
        assert li.SuffixAutomaton(train).phrases(text) == longest_matches(text, train), (train, text)


def corpus(spark, n=300):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        text = " ".join("".join(rng.choices(WORDS[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(8, 60)))
        rows.append((i, text, lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    df = corpus(spark)
    got = {r.doc_id: r for r in li.identify(df).collect()}
    want = {r.doc_id: r.lang for r in df.collect()}
    held = [i for i in want if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == set(held)
    assert sum(got[i].lang_pred == want[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_labels_of_held_out_rows_are_not_learned(spark):
    rows = [(i, "abc", "en" if zlib.crc32(str(i).encode()) % 4 != 2 else "xx") for i in range(50)]
    assert {r.lang_pred for r in li.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()} == {"en"}


def test_edges(spark):
    rows = [(1, "hello world", "en"), (3, None, "en"), (4, "123 !? ² Ⅷ", "en"), (5, "", None), (None, "hello", None), (1, "hello world", "en")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = sorted(((r.doc_id or 0), r.lang_pred, r.score) for r in li.identify(df).collect())
    assert got == [(0, "en", 1.0), (1, "en", 1.0), (1, "en", 1.0), (3, "und", 0.0), (4, "und", 0.0), (5, "und", 0.0)]
    kept = li.keep_identified(df)
    assert sorted((r.doc_id or 0, r.lang) for r in kept.collect()) == [(0, "en"), (1, "en"), (1, "en")] and kept.schema == df.schema
    assert li.identify(df.limit(0)).collect() == []
    assert li.identify(df.withColumn("lang", df.lang.substr(100, 1)).filter("doc_id = 1")).first().lang_pred in ("", "und")


def test_decision_against_brute_force(spark):
    """The whole decision, phrases across words, ties to the first by name, and the normaliser."""
    rng = random.Random(8)
    sample = [(lang, "".join(rng.choices("abc ", k=n))) for lang, n in (("aa", 60), ("bb", 300), ("cc", 60))]
    sample.append(("dd", sample[0][1]))
    model = li.Model(sample)
    for _ in range(200):
        text = "".join(rng.choices("abcd 1.", k=rng.randint(0, 40)))
        letters = "".join(w + " " for w in re.findall("[a-d]+", text))
        cost = [(longest_matches(letters, t) * math.log2(len(t)), lang) for lang, t in sample]
        best, second = sorted(cost)[:2] if letters else ((0, "und"), (1, ""))
        assert model.predict(text) == (best[1], pytest.approx((second[0] - best[0]) / second[0] if letters else 0.0)), text


def test_batches_and_single_texts_agree(monkeypatch):
    """The table of steps, few and many texts at once, and the automata by themselves all count the same phrases."""
    rng = random.Random(11)
    sample = [(lang, "".join(rng.choices("abcé ", k=200))) for lang in ("aa", "bb", "cc")]
    texts = ["".join(rng.choices("abcdé世 ", k=rng.choice([0, 1, 5, 30, 300]))) for _ in range(120)] + ["abc " * 3000, ""]
    model, plain = li.Model(sample), li.Model(sample, cells=0)
    assert model.fits and not plain.fits
    want = [[li.SuffixAutomaton(t).phrases(x) for x in texts] for _, t in sample]
    assert plain.phrases(texts).tolist() == want
    for few in (1, 24, 1000):
        monkeypatch.setattr(li, "FEW", few)
        assert model.phrases(texts).tolist() == want
        assert [model.predict(t) for t in texts[:9]] == plain.predictions(texts[:9])
    assert model.phrases([]).shape == (3, 0)


def test_phrases_reach_over_words():
    model = li.Model([("aa", "one two three "), ("bb", "one. two. three. ")])
    assert model.phrases(["one two three "])[:, 0].tolist() == [1, 4] and model.predict("one two three")[0] == "aa"


def test_very_many_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(li, "SAMPLE_LANGS", 3)
    monkeypatch.setattr(li, "SAMPLE_TOTAL", 30)
    rows = [(i, "some words of a text here", f"l{i % 7}") for i in range(70)] + [(100 + i, "some words", "l9") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = li.labelled_sample(df, "doc_id", "text", "lang", li.SAMPLE_CHARS, li.SAMPLE_DOCS)
    assert len(found) == 3 and "l9" in dict(found) and all(len(t) <= 10 for _, t in found)
    assert {r.lang_pred for r in li.identify(df).collect()} <= set(dict(found))


def test_null_labels_are_filled_and_long_texts_read_whole(spark):
    rows = [(i, "the and of the and", "en") for i in range(8)] + [(10 + i, "der und ung der und", "de") for i in range(8)]
    rows += [(30, "the and " + "der und ung " * 60_000, None), (31, None, None), (32, "the and of", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.lang for r in li.keep_identified(df).collect()}
    assert kept[30] == "de" and kept[32] == "xx" and 31 not in kept and len(kept) == 18
    assert 30 not in {r.doc_id for r in li.keep_identified(df, least_score=0.99).collect()}


def test_unlabelled_corpus_is_kept(spark):
    held_out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)
    for lang in (None, "en"):
        rows = [(held_out, "hello world", lang), (held_out, "123 !? ² Ⅷ", lang), (held_out, "", lang), (held_out, None, lang), (held_out, "čau", lang)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        assert sorted(r.text for r in li.keep_identified(df).collect()) == ["hello world", "čau"]
