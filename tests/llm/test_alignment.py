import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from veriframe.llm import alignment as al

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokens():
    return al.Tokens(A, B)


def encoded(tokens, text):
    """Both tokenizers' tokens of a whole text, as their own libraries give them."""
    a = tokens.a.encode(" " + text, add_special_tokens=False).ids
    b = tokens.b.encode(text)
    whole = (" " + text).encode()
    left, right = [tokens.a_bytes[i] for i in a], [tokens.b_bytes[i] for i in b]
    return (a, left, b, right) if text and b"".join(left) == whole == b"".join(right) else ([], [], [], [])


def brute(tokens, rows):
    docs = []
    for i, text in rows:
        a, left, b, right = encoded(tokens, text or "")
        ends = []
        for pieces in (left, right):
            at, out = 0, []
            for p in pieces:
                at += len(p)
                out.append(at)
            ends.append(out)
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups = []
        low = 0
        for high in shared:
            groups.append(([t for t, e in zip(a, ends[0]) if low < e <= high], [t for t, e in zip(b, ends[1]) if low < e <= high]))
            low = high
        links = [(x, y) for x, e in zip(a, ends[0]) for y, f in zip(b, ends[1]) if e == f]
        docs.append((i, a, b, groups, links))
    count = Counter(link for d in docs for link in d[4])
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for i, a, b, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if a else ""
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), sha))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, i, "k") for i, t in rows], "doc_id long, text string, n long, chunk string")


ROWS = [
    (1, "The quick brown fox, it's over 1000 lazy dogs."),
    (2, None),
    (3, ""),
    (4, " "),
    (5, "   leading and   inner  spaces  "),
    (6, "tabs\tand\n\n lines \r\n mixed \x0b \x0c ends\n"),
    (7, "no break  em  　wide   sep \x85 next"),
    (8, "bad ▁ block"),
    (9, "unspaced日本語テキスト" * 40),
    (10, "<|endoftext|> </s><s> <unk> <0x41> <pad>"),
    (11, "é é ﬁ 🤖🤖 नमस्ते"),
    (12, "x" * 3000 + " y"),
    (13, "\x00nul \x1c\x1f controls"),
    (14, "bad ▁"),
    (1, "The quick brown fox, it's over 1000 lazy dogs."),
    (1, "another text of a repeated id"),
    (None, "null id, quick brown fox"),
    (15, "don't we'll 'tis ' s 's"),
    (16, "one trailing space "),
]


@pytest.mark.parametrize("hot", [al.HOT_CHUNKS, 12, 0])
def test_against_brute_force(spark, tokens, hot):
    rng = random.Random(5)
    words = ["the", "quick", "brown,", "foxes", "jumped", "überall", "ñandú", "it's", "\n", "x1y2", "--", "tion", "anhe"]
    rows = ROWS + [(100 + k, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(80)]
    assert result(al.align(frame(spark, rows), A, B, hot_chunks=hot)) == brute(tokens, rows)


def test_many_copies_of_a_text_are_spread(spark, tokens):
    rows = [(k, "one text with rarechunk" + str(7)) for k in range(300)] + [(1000 + k, f"text number {k} alone") for k in range(40)]
    assert result(al.align(frame(spark, rows), A, B, hot_chunks=3, hot_rows=20)) == brute(tokens, rows)


def test_joined_pairs_say_the_same(spark, tokens, monkeypatch):
    monkeypatch.setattr(al.entries, "__defaults__", (0,))
    assert result(al.align(frame(spark, ROWS), A, B, hot_chunks=5)) == brute(tokens, ROWS)


def test_empty_and_only_lost_texts(spark):
    assert al.align(frame(spark, ROWS).limit(0), A, B).collect() == []
    got = result(al.align(frame(spark, [(1, None), (2, "▁"), (3, "")]), A, B))
    assert got == [(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2, 3)]


TEXTS = st.text(st.sampled_from(list("ab1'.,s ñ\t\n\r\x0b\x85\xa0  　▁é🤖") + [" "] * 6), max_size=40)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_chunks_join_nothing(tokens, text):
    """Chunks cover the text, the JVM's way to cut them is the same, and their tokens are the whole text's."""
    found = al.CHUNK.findall(" " + text)
    assert "".join(found) == " " + text and found == al.chunks_of(text) == re.split(al.SPLIT, " " + text)
    a = [i for c in found for i in list(tokens.encode([c]))[0][0]]
    b = [i for c in found for i in list(tokens.encode([c]))[0][1]]
    assert a == tokens.a.encode(" " + text, add_special_tokens=False).ids
    if "▁" not in text and text:
        assert b == tokens.b.encode(text)


def test_jvm_cuts_alike(spark):
    rng = random.Random(1)
    rows = [(k, "".join(rng.choices("ab ñ\t\n\r\x0b\x1c\x85\xa0  　   ", k=30))) for k in range(500)]
    df = frame(spark, rows)
    for r in df.select("text", al.chunks(df["text"]).alias("c")).collect():
        assert r.c == al.CHUNK.findall(" " + r.text)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        al.Tokens.of(public_tokenizers.path("word_bpe_49k.json"), B)


def test_no_exchange_between_the_joins(spark):
    rows = spark.createDataFrame([(0, "a", 1, [1], [1], [2], [1])], "id long, chunk string, n long, a array<int>, a_size array<smallint>, b array<int>, b_size array<smallint>")
    with al._settings(spark, al.CO_PARTITIONED):
        plan = al.aligned(rows)._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan and "BroadcastExchange" not in plan


def test_texts_are_coded_once(spark):
    rows = [(i, f"some words and rare{i} things") for i in range(40)]
    found = al.align(frame(spark, rows), A, B, hot_chunks=3)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and plan.count("names#") and "xxhash64" in plan
    assert len([x for x in plan.splitlines() if "MapInArrow packed(" in x]) == 1 and "MapInArrow missing(" not in plan
