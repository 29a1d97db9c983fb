import math
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from veriframe.llm import sentencepiece_codec as sc

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=PATH)
CODEC = sc.Codec(PATH)


def numbers(data):
    return np.frombuffer(data, "<u4").tolist()


@given(st.one_of(st.text(max_size=50), st.text(alphabet="the norisa.\n\tß世 ▁1", max_size=80)))
@settings(max_examples=500, deadline=None)
def test_ids_and_text_equal_the_librarys(text):
    ids = CODEC.encode(text)
    assert numbers(ids) == LIBRARY.encode(text)
    assert CODEC.decode(ids) == LIBRARY.decode(numbers(ids))
    if "▁" not in text:
        assert CODEC.decode(ids) == text


def test_long_text_without_spaces():
    text = "".join(random.Random(1).choices("thenorisabc", k=60_000))
    assert numbers(CODEC.encode(text)) == LIBRARY.encode(text)


def test_faulty_bytes():
    ids = [CODEC.pieces.byte_ids[0xC3], CODEC.pieces.ids["a"]]
    assert CODEC.decode(np.array(ids, "<u4").tobytes()) == LIBRARY.decode(ids)


def scored(names):
    score = {p: math.log(0.9 / len(names)) * (0.5 + len(p) % 3) for p in names}
    return sc.Pieces(score, {p: k + 1 for k, p in enumerate(names)}, [], 0, merges=False)


def test_scored_pieces_against_full_search():
    rng = random.Random(7)
    pieces = scored(["a", "b", "ab", "ba", "abb", "bab", "aabb"])
    for _ in range(200):
        text = "".join(rng.choices("abc", k=rng.randint(0, 14)))

        def best(i):
            if i == len(text):
                return 0.0
            steps = [pieces.score[text[i:j]] + best(j) for j in range(i + 1, len(text) + 1) if text[i:j] in pieces.score]
            return max([*steps, *([sc.UNKNOWN_SCORE + best(i + 1)] if text[i] not in pieces.score else [])])

        found = list(sc.viterbi(text, pieces))
        assert "".join(found) == text
        assert sum(pieces.score.get(p, sc.UNKNOWN_SCORE) for p in found) == pytest.approx(best(0))


def test_window_commits_before_the_end():
    pieces = scored(["a", "b", "ab"])
    seen = []

    def source():
        for k in range(10_000):
            seen.append(k)
            yield "ab"[k % 2]

    first = next(sc.viterbi(source(), pieces))
    assert first in ("a", "ab") and len(seen) < 50


def test_all_ids_come_from_the_streaming_search(monkeypatch):
    calls = []
    search = sc.viterbi
    monkeypatch.setattr(sc, "viterbi", lambda blocks, *a: calls.append(1) or search(blocks, *a))
    text = "the unbelievable  words\n" + "x" * 3000
    assert numbers(sc.Codec(PATH).encode(text)) == LIBRARY.encode(text) and len(calls) == 5
    monkeypatch.setattr(sc, "viterbi", lambda *a: iter(["a"]))
    assert numbers(sc.Codec(PATH).encode("zebra")) != LIBRARY.encode("zebra")


def test_memory_is_bounded_on_a_long_unspaced_text():
    """What was fed and not yet given out stays a few windows long, and the ids are the library's."""
    rng = random.Random(2)
    text, fed, given, held = sc.SPACE + "".join(rng.choices(["the", "ing", "世界", "é", "un", "q", "0", "anti"], k=100_000)), 0, 0, 0

    def source():
        nonlocal fed
        for block in sc.blocks(text):
            fed += len(block)
            yield block

    out = []
    for piece in sc.viterbi(source(), CODEC.pieces):
        given += len(piece)
        held = max(held, fed - given)
        out.append(piece)
    assert "".join(out) == text and held < sc.BLOCK + 6 * CODEC.pieces.longest
    assert numbers(b"".join(map(CODEC.pieces.id_bytes, out))) == numbers(CODEC.encode(text[1:])) == LIBRARY.encode(text[1:])


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    for change in ("normaliser", "prefix", "user", "type", "space"):
        model = pb.ModelProto()
        with open(PATH, "rb") as f:
            model.ParseFromString(f.read())
        if change == "normaliser":
            model.normalizer_spec.remove_extra_whitespaces = True
        elif change == "prefix":
            model.normalizer_spec.add_dummy_prefix = False
        elif change == "user":
            model.pieces[500].type = model.pieces[500].USER_DEFINED
        elif change == "type":
            model.trainer_spec.model_type = 3
        else:
            model.pieces[500].piece = "a" + sc.SPACE
        path = tmp_path / f"{change}.model"
        path.write_bytes(model.SerializeToString())
        with pytest.raises(ValueError):
            sc._checked(str(path))


def test_operator(spark):
    rows = [(1, "the world\n\n  x"), (2, None), (3, ""), (None, "é世"), (1, "the world\n\n  x")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, ids int")
    got = sc.encode(df, PATH, outputs=("ids", "round_trip", "ids_crc32"))
    assert all(r.round_trip for r in got.collect())
    for r in got.collect():
        text = {1: "the world\n\n  x", None: "é世"}.get(r.doc_id, "")
        assert r.ids == LIBRARY.encode(text) and r.n_ids == len(r.ids)
    assert sorted(r.text for r in sc.decode(got, PATH).collect()) == sorted(t or "" for _, t in rows)
    assert sc.encode(df.limit(0), PATH).collect() == []


def test_cache_overflow():
    old, sc.CHUNK_CACHE, sc.PREFIX_CACHE = (sc.CHUNK_CACHE, sc.PREFIX_CACHE), 5, 7
    try:
        text = "some words that fill the small cache, and some words again"
        assert numbers(sc.Codec(PATH).encode(text)) == LIBRARY.encode(text)
    finally:
        sc.CHUNK_CACHE, sc.PREFIX_CACHE = old
