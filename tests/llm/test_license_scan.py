import random
import textwrap

from veriframe.llm import license_scan as ls
from veriframe.llm.license_texts import TEMPLATES

KNOWN = ls.Templates(TEMPLATES, ls.THRESHOLD)


def dice(a, b):
    x, y = ls.bigrams(ls.words(a)), ls.bigrams(ls.words(b))
    return 2 * sum((x & y).values()) / (x.total() + y.total())


def test_pruning_loses_no_match():
    rng = random.Random(1)
    for name, text in TEMPLATES.items():
        ws = text.split()
        for _ in range(20):
            other = list(ws)
            for _ in range(rng.randint(0, max(1, len(ws) // 6))):
                other[rng.randrange(len(other))] = "changed"
            line = " ".join(other)
            exact = max(dice(line, t) for t in TEMPLATES.values())
            found = KNOWN.best(ls.words(line))[0]
            assert found == (exact if exact >= ls.THRESHOLD else 0.0)
            if exact >= ls.THRESHOLD:
                assert not KNOWN.keys.isdisjoint(ls.bigrams(ls.words(line))), name


def test_whole_wrapped_texts_and_lines():
    for name in ("MIT", "BSD-2-Clause", "Zlib", "GPL-3.0 header", "Apache-2.0 header", "ISC"):
        text = "before\n" + "\n".join(textwrap.wrap(TEMPLATES[name], 50)) + "\nafter"
        assert [m[2] for m in KNOWN.scan(text)] == [name]
    assert KNOWN.scan("x y z and so on. Licensed under CC BY-NC 4.0. more words of the text")[0][2] == "CC-BY-NC-4.0 line"
    assert KNOWN.scan("of the and to the in the " * 5000) == []


def test_operator(spark):
    rows = [(1, "a b\nReleased under the MIT License."), (1, "a b\nReleased under the MIT License."), (2, None), (3, ""), (None, "All rights reserved."), (4, "clean words " * 20_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = sorted(((r.doc_id or 0), r.line, r.lines, r.license, r.dice) for r in ls.scan(df).collect())
    assert got == [(0, 0, 1, "All rights reserved", 1.0), (1, 1, 1, "MIT notice", 1.0), (1, 1, 1, "MIT notice", 1.0)]
    assert ls.scan(df.limit(0)).collect() == []


def test_several_texts_in_one_document():
    wrap = lambda name: "\n".join(textwrap.wrap(TEMPLATES[name], 60))
    names = lambda text: [m[2] for m in KNOWN.scan(text)]
    for pair in (("MIT", "MIT"), ("MIT", "BSD-2-Clause"), ("MIT", "ISC"), ("BSD-2-Clause", "ISC"), ("Zlib", "Apache-2.0 header")):
        for between in ("\n", "\n\n", "\nCopyright 2020 Somebody\n", " "):
            assert names(between.join(map(wrap, pair))) == list(pair)
            assert names(between.join(map(wrap, pair)).replace("\n", " ")) == list(pair)
    assert names(wrap("MIT") + "\nReleased under the MIT License.\nAll rights reserved.") == ["MIT", "MIT notice", "All rights reserved"]
    assert names("x Released under the MIT License. y Licensed under CC BY 4.0. z All rights reserved.") == ["MIT notice", "CC-BY-4.0 short", "All rights reserved"]
    assert KNOWN.scan("a\nReleased under\nthe\nMIT License.\nb\nAll\nrights reserved.") == [(1, 3, "MIT notice", 1.0), (5, 2, "All rights reserved", 1.0)]
    changed = TEMPLATES["MIT"].replace("without restriction", "with no limit at all").replace("sublicense, ", "")
    assert names(changed + " " + TEMPLATES["MIT"] + " " + changed) == ["MIT"] * 3
    many = KNOWN.scan("All rights reserved. Released under the MIT License. " * 2000)
    assert len(many) == 4000


def test_bsd_3_is_not_bsd_2():
    for name in ("BSD-3-Clause", "BSD-2-Clause"):
        assert [m[2] for m in KNOWN.scan("Copyright (c) 2001 A. Body\n" + "\n".join(textwrap.wrap(TEMPLATES[name], 72)))] == [name]


def test_ties_go_to_the_last_by_name():
    twins = {"a": "some words of a text", "c": "some words of a text", "b": "some words of a text"}
    known = ls.Templates(twins, 0.8)
    assert known.best(ls.words("some words of a text")) == (1.0, "c") and [m[2] for m in known.scan("x\nsome words\nof a text")] == ["c"]


def test_scan_against_every_window():
    """Whatever window of a text reaches the threshold, a match overlaps it; every match has the Dice that it says, and none overlap."""
    rng = random.Random(5)
    texts = {"one": "alpha beta gamma delta epsilon zeta eta theta", "two": "alpha beta kappa lambda mu", "three": "zeta eta theta iota"}
    known = ls.Templates(texts, 0.8)
    found = 0
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(1, 4)):
            ws = rng.choice(list(texts.values())).split()
            if rng.random() < 0.5:
                ws[rng.randrange(len(ws))] = rng.choice(["x", "y", ""])
            parts.append(" ".join(ws) + rng.choice([" ", "\n", " q r s t u v w "]))
        text = "".join(parts)
        ws = ls.words(text)
        lines = [k for k, line in enumerate(text.split("\n")) for _ in ls.words(line)]
        spans = [(a, a + n, max(known.best(ls.words(" ".join(ws[a : a + n])))[0], 0)) for a in range(len(ws)) for n in range(3, min(14, len(ws) - a) + 1)]
        matches = known.scan(text)
        found += len(matches)
        assert bool(matches) == any(d >= 0.8 for *_, d in spans), text
        assert sum(n for _, n, *_ in matches) <= len(set(lines)) + len(matches)
        for line, count, name, dice in matches:
            assert any(lines[a] == line and lines[b - 1] == line + count - 1 and abs(globals()["dice"](" ".join(ws[a:b]), texts[name]) - dice) < 1e-9 for a, b, d in spans if d), text
    assert found > 300
