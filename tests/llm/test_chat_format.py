from veriframe.llm import chat_format as cf

ROWS = [
    (1, 0, "user", "Hello there\nsecond line"),
    (1, 1, "assistant", "> Hello there\n> second line\nHi!"),
    (1, 2, "user", "> > Hello there\n> > second line\n> Hi!\nOn Monday x wrote:\n> second   LINE\nok"),
    (1, 3, "assistant", "no quote"),
    (1, 4, "user", "On Monday x wrote:\n> Hi!\nthanks\n"),
    (1, 5, "user", "> said nowhere\n>> Hi!\nalone"),
    (2, 0, None, None),
    (2, 1, "user", "> Hi!\nother conversation"),
    (None, None, "user", "x"),
]
SCHEMA = "conv_id long, turn long, role string, text string, thread string"


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def test_links(spark):
    got = {(r.conv_id, r.turn): (r.content, r.reply_to, r.thread, r.depth) for r in cf.linked_messages(frame(spark)).collect()}
    assert got == {
        (1, 0): ("Hello there\nsecond line", None, 0, 0),
        (1, 1): ("Hi!", 0, 0, 1),
        (1, 2): ("ok", 0, 0, 1),  # most quoted characters at level 1 are of turn 0
        (1, 3): ("no quote", None, 3, 0),
        (1, 4): ("thanks", 1, 0, 2),
        (1, 5): ("alone", 1, 0, 2),  # level 1 links nothing, level 2 does
        (2, 0): ("", None, 0, 0),
        (2, 1): ("other conversation", None, 1, 0),
        (None, None): ("x", None, None, 0),
    }


def test_reply_order(spark):
    got = {r.conv_id: r for r in cf.conversations(frame(spark)).collect()}
    assert (got[1].messages, got[1].links) == (6, 4)
    assert [x.split("\n")[1] for x in got[1].chat.split("<|im_start|>")[1:]] == ["Hello there", "Hi!<|im_end|>", "ok<|im_end|>", "thanks<|im_end|>", "alone<|im_end|>", "no quote<|im_end|>"]
    assert ">" not in got[1].chat.replace("<|im_start|>", "").replace("<|im_end|>", "")
    assert got[2].chat.startswith("<|im_start|>unknown\n<|im_end|>")


def test_long_chain_of_replies(spark):
    rows = [(7, 0, "user", "message 0")] + [(7, k, "user", f"> message {k - 1}\nmessage {k}") for k in range(1, 40)]
    got = {r.turn: (r.thread, r.depth) for r in cf.linked_messages(frame(spark, rows)).collect()}
    assert got == {k: (0, k) for k in range(40)}
    parts = cf.conversations(frame(spark, rows), part_turns=16).collect()
    assert sorted((r.part, r.messages) for r in parts) == [(0, 16), (1, 16), (2, 8)]


def test_repeated_rows_and_empty(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "user", "> a\nb"), (1, 1, "user", "> a\nb")]
    got = [(r.turn, r.reply_to) for r in cf.linked_messages(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == [(0, None), (0, None), (1, 0), (1, 0)]
    assert cf.conversations(frame(spark).limit(0)).collect() == []


def test_order_does_not_depend_on_the_parts(spark):
    rows = [(7, k * 1_000_003, "user", f"message {k}") for k in range(30)] + [(7, k * 1_000_003, "user", f"> message {k % 7}\nanswer {k}") for k in range(30, 60)]
    rows += [(8, 5, "user", "a"), (8, 10**9, "user", "> a\nb")] + [(9, None, "user", f"x {k % 3}") for k in range(40)] + [(10, 4, "user", f"y {k}") for k in range(40)] + [(None, 1, "user", "z")] * 20
    df = frame(spark, rows)
    whole = {r.conv_id: r for r in cf.conversations(df).collect()}
    assert len(whole) == 5 and whole[8].messages == 2
    for part_turns in (7, 16):
        parts = cf.conversations(df, part_turns=part_turns).collect()
        for conv, r in whole.items():
            mine = sorted((p for p in parts if p.conv_id == conv), key=lambda p: p.part)
            assert [p.part for p in mine] == list(range(-(-r.messages // part_turns)))
            assert all(p.messages == part_turns for p in mine[:-1]) and sum(p.links for p in mine) == r.links
            assert "\n".join(p.chat for p in mine) == r.chat
    first = next(p for p in parts if (p.conv_id, p.part) == (7, 0)).chat
    assert first.index("message 0<") < first.index("answer 35<") < first.index("message 1<")


def test_messages_that_share_a_turn_stay_apart(spark):
    rows = [(1, 0, "user", "first"), (1, 1, "user", "> first\nquoting"), (1, 1, "user", "not quoting"), (1, None, "user", "> first\nno turn"), (1, 2, "user", "> not quoting\nthird")]
    got = {r.content: (r.turn, r.reply_to, r.thread, r.depth) for r in cf.linked_messages(frame(spark, rows)).collect()}
    assert got == {"first": (0, None, 0, 0), "quoting": (1, 0, 0, 1), "not quoting": (1, None, 1, 0), "no turn": (None, None, None, 0), "third": (2, 1, 1, 1)}
    chat = cf.conversations(frame(spark, rows)).collect()[0].chat
    order = [x.split("\n")[1].removesuffix("<|im_end|>") for x in chat.split("<|im_start|>")[1:]]
    assert order == ["no turn", "first", "quoting", "not quoting", "third"]
