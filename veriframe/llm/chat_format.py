"""Chat formatting by quotation linking, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.llm.common import cut
from veriframe.operators.joins import broadcast_if_small

#: Messages of one conversation that are rendered into one row; longer conversations go on in further rows.
PART_TURNS = 1000
#: A formatted message: role, content.
FRAME = "<|im_start|>%s\n%s<|im_end|>"
_QUOTE = r"^\s{0,3}(?:>[ \t]?)+"
#: The line that introduces a quote, as mail programs write it.
_INTRODUCTION = r"^.{0,200}(wrote|writes|said|schrieb|a écrit|escribió)\s?:\s*$"


def passages(text: Column) -> Column:
    """Array of (level, text): runs of lines of one quote level, in order; level 0 is the message's own."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, _QUOTE, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, _QUOTE, "").alias("line")))

    def of(ls: Column) -> Column:
        edges = F.filter(F.sequence(F.lit(0), F.size(ls)), lambda i: (i == 0) | (i == F.size(ls)) | ~F.get(ls, i)["level"].eqNullSafe(F.get(ls, i - 1)["level"]))

        def run(es: Column) -> Column:
            return F.transform(
                F.slice(es, F.lit(1), F.size(es) - 1),
                lambda b, k: F.struct(F.get(ls, b)["level"].alias("level"), F.array_join(F.transform(F.slice(ls, b + 1, F.get(es, k + 1) - b), lambda x: x["line"]), "\n").alias("text")),
            )

        return F.element_at(F.transform(F.array(edges), run), 1)

    return F.element_at(F.transform(F.array(lines), of), 1)


def normalised(text: Column) -> Column:
    """What is hashed: lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _own(parts: Column) -> Column:
    """The message without quotes and the lines that introduce them."""

    def kept(p: Column, k: Column) -> Column:
        lines = F.split(F.rtrim(p["text"]), "\n")
        led = (F.get(parts, k + 1)["level"] > 0) & F.element_at(lines, -1).rlike(_INTRODUCTION)
        return F.when(F.coalesce(led, F.lit(False)), F.array_join(F.slice(lines, F.lit(1), F.size(lines) - 1), "\n")).otherwise(p["text"])

    own = F.filter(F.transform(parts, lambda p, k: F.struct(p["level"].alias("level"), kept(p, k).alias("text"))), lambda p: p["level"] == 0)
    return F.regexp_replace(F.array_join(F.transform(own, lambda p: p["text"]), "\n"), r"^\s+|\s+$", "")


def _hashes(text: Column) -> Column:
    """(hash, weight) of a passage and of each of its lines; blank ones have none."""
    units = F.array_distinct(F.concat(F.array(normalised(text)), F.transform(F.split(text, "\n"), normalised)))
    return F.transform(F.filter(units, lambda u: u != ""), lambda u: F.struct(F.sha2(u, 256).alias("hash"), F.length(u).alias("weight")))


def linked_messages(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: (conv_id, turn, role, content, quotes, reply_to, thread, depth).

    content is the message without quotes. Every quoted passage, whole and by line, is hashed and joined to the first message of
    the conversation that has the same passage or line of its own. reply_to is the earlier turn whose text
    is quoted at the shallowest level that links at all; of several the one with most quoted characters, then the latest. thread is
    the turn at the root of the replies and depth the number of replies from there; messages that quote nothing known are roots.
    Keys are (conversation, hash) and a number of the message, so a huge conversation is spread over tasks, and messages that share a turn stay apart.

    Null text counts as empty, a null role stays null, messages with a null conversation or turn link to nothing and are linked to by none.
    Repeated rows each get the same link. Of several messages of one turn that have a passage, one is linked to. An empty table gives an empty result. Extra columns are not read.
    """
    return _linked(messages, conv, turn, role, text).drop("id", "root")


def _linked(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``linked_messages`` with the number of each message and, as root, of the message that its thread begins with."""
    own = messages.select(messages[conv].alias("conv_id"), messages[turn].alias("turn"), messages[role].alias("role"), passages(F.coalesce(messages[text], F.lit(""))).alias("parts"))
    own = own.select("conv_id", "turn", "role", _own(F.col("parts")).alias("content"), F.filter("parts", lambda p: p["level"] > 0).alias("quotes"))
    own = cut(own.withColumn("id", F.monotonically_increasing_id()))
    quoted = own.select("conv_id", "turn", "id", F.explode("quotes").alias("q")).select("conv_id", "turn", "id", "q.level", F.explode(_hashes(F.col("q.text"))).alias("u")).select("conv_id", "turn", "id", "level", "u.hash", "u.weight")
    units = own.filter("turn IS NOT NULL").select("conv_id", "turn", "id", F.explode(_hashes(F.col("content"))).alias("u"))
    said = units.groupBy("conv_id", F.col("u.hash").alias("hash")).agg(F.min(F.struct("turn", "id")).alias("origin"))
    hits = cut(quoted).join(cut(said), ["conv_id", "hash"]).filter("origin.turn < turn")
    voted = hits.groupBy("id", "turn", "level", "origin").agg(F.sum("weight").alias("weight"))
    links = voted.groupBy("id", "turn").agg(F.max_by("origin", F.struct((-F.col("level")).alias("l"), "weight", "origin")).alias("origin"))
    placed = _threads(cut(links))
    rows = own.select("id", "conv_id", "turn", "role", "content", F.size("quotes").alias("quotes")).join(placed, "id", "left")
    return rows.select("id", F.coalesce("root", "id").alias("root"), "conv_id", "turn", "role", "content", "quotes", "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"))


def _threads(links: DataFrame) -> DataFrame:
    """(id, reply_to, root, thread, depth) by pointer doubling: the rounds are the logarithm of the longest chain of replies."""
    state = links.select("id", F.col("origin.turn").alias("reply_to"), F.col("origin.id").alias("root"), F.col("origin.turn").alias("thread"), F.lit(1).alias("depth"))
    while True:
        up = state.select(F.col("id").alias("root"), F.col("root").alias("further"), F.col("thread").alias("first"), F.col("depth").alias("more"))
        moved = state.join(up, "root", "left")
        state = cut(moved.select("id", "reply_to", F.coalesce("further", "root").alias("root"), F.coalesce("first", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("moved")))
        if state.filter("moved").isEmpty():
            return state.drop("moved")


def _positions(rows: DataFrame) -> DataFrame:
    """``rows`` with a column position, which counts the messages of every conversation from 0 in the order of replies.

    The rows are dealt by ranges of that order, so that a huge conversation is spread, also where turns repeat or are null;
    only one count for each range and conversation is summed up.
    """
    order = ["conv_id", "thread", "root", "depth", "turn", "tie", "id"]
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("nth", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("range", F.shiftright("nth", 33))
    spans = dealt.groupBy("conv_id", "range").agg(F.min("nth").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), (before - F.col("first")).alias("shift"))
    return dealt.join(spans, (F.col("range") == F.col("r")) & F.col("conv_id").eqNullSafe(F.col("c"))).withColumn("position", F.col("nth") + F.col("shift"))


def conversations(messages: DataFrame, part_turns: int = PART_TURNS, **columns: str) -> DataFrame:
    """Formatted conversations: (conv_id, part, messages, links, chat).

    Messages stand in the order of replies: thread by thread, each message after what it answers (by depth, then turn).
    A conversation fills one row for every ``part_turns`` messages in that order, so no row gathers an unbounded group. Handling of
    nulls, repeated rows and empty tables is that of ``linked_messages``; a null role is written as "unknown".
    """
    rows = _linked(messages, **columns)
    line = F.format_string(FRAME, F.coalesce("role", F.lit("unknown")), F.col("content"))
    rows = rows.select("conv_id", "thread", "root", "depth", "turn", "reply_to", "id", line.alias("line"))
    rows = cut(rows.withColumn("tie", F.xxhash64("line")))
    # conversations of one row need no positions; the others, at most one in part_turns rows, are broadcast if they are few
    long = rows.groupBy("conv_id").count().filter(F.col("count") > part_turns).select(F.col("conv_id").alias("c"), F.lit(True).alias("long"))
    known = rows.join(broadcast_if_small(cut(long)), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    kept = ["conv_id", "thread", "root", "depth", "turn", "tie", "reply_to", "line"]
    short = known.filter("long is null").select(*kept, F.lit(0).cast("long").alias("part"))
    numbered = _positions(known.filter("long").select(*kept, "id"))
    whole = short.unionByName(numbered.select(*kept, F.floor(F.col("position") / part_turns).cast("long").alias("part")))
    item = F.struct("thread", "root", "depth", "turn", "tie", "line")
    grouped = whole.groupBy("conv_id", "part").agg(F.count("*").alias("messages"), F.count("reply_to").alias("links"), F.sort_array(F.collect_list(item)).alias("items"))
    return grouped.select("conv_id", "part", "messages", "links", F.array_join(F.transform("items", lambda x: x["line"]), "\n").alias("chat"))
