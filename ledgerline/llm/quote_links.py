"""Quotation linking: replies find the messages they quote, and conversations are put in reply order.

DataFrame functions only. Lines are parsed into quote levels; neighbouring quoted lines of one level
are a passage. Passages, and their lines one by one, are normalised and hashed and joined to the
first message of the conversation that says the same in its own words: one row per conversation and
hash is what a quote can meet, however often a sentence is repeated. A message replies to the earlier
message that the characters of its lowest matched quote level come from most (the later one of
several). Threads are followed by doubling steps, so a long chain costs a few joins. In a thread each
reply stands under the message it answers, replies to one message by turn: a walk around the tree of
replies, down into and up from every message, is a list, and doubling steps rank it.

Every row of the table gives one row, ordered by conversation, thread and place in the thread. Messages are told
apart by (conv_id, turn); rows that share both pool their quotes. Null texts are empty; rows without
turn quote nothing and are quoted by nothing, rows without conv_id form one conversation; extra
columns are left alone. Hashes are 64 bits, within one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.tables import read, stored
from ledgerline.operators.positions import with_position

MARKS = r"^((?:[ \t]{0,3}>)+)[ \t]?"
#: A line that announces a quote; it goes if the quote follows.
ANNOUNCES = r"^[ \t]*(?:On|Am|Le|El)\b.*\b(?:wrote|schrieb|a écrit|escribió)\b.*:[ \t]*$"
GAP = "\u0001"


def parsed(lines: Column) -> Column:
    """Level and content of every line; announcing lines before a quote have level -1."""
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", ""))

    def line(x: Column, i: Column) -> Column:
        follows = level(F.coalesce(F.get(lines, i + 1), F.lit(""))) > 0
        dropped = (level(x) == 0) & x.rlike(ANNOUNCES) & follows
        return F.struct(F.when(dropped, -1).otherwise(level(x)).alias("level"), F.regexp_replace(x, MARKS, "").alias("said"))

    return F.transform(lines, line)


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _at_level(lines: Column, level: Column) -> Column:
    """The passages of one level: lines of other levels part them."""
    marked = F.transform(lines, lambda x: F.when(x["level"] == level, x["said"]).otherwise(F.lit(GAP)))
    return F.split(F.array_join(marked, "\n"), f"\n?{GAP}\n?")


def _units(passages: Column) -> Column:
    """Normalised passages and their lines, each once."""
    lines = F.flatten(F.transform(passages, lambda p: F.split(p, "\n")))
    return F.array_remove(F.array_distinct(F.transform(F.concat(passages, lines), normal)), "")


def messages(table: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without quotes, parsed lines and deepest level of every row."""
    held = table.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\r?\n").alias("raw"),
    ).select("conv_id", "turn", "role", parsed(F.col("raw")).alias("lines"))
    own = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["said"]), "\n")
    depth = F.greatest(F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0)), F.lit(0))
    return held.select("conv_id", "turn", "role", "lines", F.btrim(own, F.lit("\n")).alias("text"), depth.alias("quote_depth"))


def reply_links(said: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to for messages that quote an earlier message of their conversation."""
    known = said.where("turn is not null")
    spoken = F.concat(F.array("text"), F.split("text", r"\n[ \t]*\n"))
    first = (
        known.select("conv_id", "turn", F.explode(_units(spoken)).alias("unit"))
        .groupBy("conv_id", F.xxhash64("unit").alias("unit"))
        .agg(F.min("turn").alias("origin"))
    )
    levels = F.transform(F.sequence(F.lit(1), F.col("quote_depth")), lambda k: F.struct(k.alias("level"), _units(_at_level(F.col("lines"), k)).alias("units")))
    quoted = (
        known.where("quote_depth > 0")
        .select("conv_id", "turn", F.explode(levels).alias("q"))
        .select("conv_id", "turn", "q.level", F.explode("q.units").alias("unit"))
        .select("conv_id", "turn", "level", F.length("unit").alias("chars"), F.xxhash64("unit").alias("unit"))
    )
    q, o = quoted.alias("q"), first.alias("o")
    met = q.join(o, F.col("q.conv_id").eqNullSafe(F.col("o.conv_id")) & (F.col("q.unit") == F.col("o.unit")) & (F.col("o.origin") < F.col("q.turn")))
    votes = met.groupBy("q.conv_id", "q.turn", "q.level", "o.origin").agg(F.sum("chars").alias("chars"))
    best = F.max_by("origin", F.struct(-F.col("level"), "chars", "origin"))
    return votes.groupBy("conv_id", "turn").agg(best.alias("reply_to"))


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, thread, depth: the first message each reply goes back to, and how far."""
    at = stored(links.select("*", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")))
    while True:
        a, b = at.alias("a"), at.select("conv_id", "turn", F.col("thread").alias("above"), F.col("depth").alias("more")).alias("b")
        same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.thread") == F.col("b.turn"))
        at = stored(
            a.join(b, same, "left").select(
                "a.conv_id", "a.turn", "a.reply_to", F.coalesce("b.above", "a.thread").alias("thread"), (F.col("a.depth") + F.coalesce("b.more", F.lit(0))).alias("depth"), F.col("b.turn").isNotNull().alias("moved")
            )
        )
        if at.where("moved").isEmpty():
            return at.drop("moved")
        at = at.drop("moved")


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))


def places(at: DataFrame) -> DataFrame:
    """conv_id, turn, place: how many messages of its thread stand before each one, replies under what
    they answer. ``at`` comes from ``threads``; the first messages of threads are added."""
    replies = at.select("conv_id", "turn", F.col("reply_to").alias("parent"), "thread", "depth")
    firsts = at.select("conv_id", F.col("thread").alias("turn"), F.lit(None).cast("long").alias("parent"), "thread", F.lit(0).cast("long").alias("depth"))
    nodes = stored(replies.unionByName(firsts.distinct()))
    answered = nodes.where("parent is not null").select("conv_id", "parent", "turn")
    first_reply = answered.groupBy("conv_id", "parent").agg(F.min("turn").alias("first_reply"))
    # The next reply to the same message stands next in this order, wherever its ranges are cut.
    ordered = stored(with_position(answered, [F.asc("conv_id"), F.asc("parent"), F.asc("turn")]))
    o, x = ordered.alias("o"), ordered.withColumn("position", F.col("position") - 1).alias("x")
    beside = o.join(x, (F.col("o.position") == F.col("x.position")) & _same("o", "x") & (F.col("o.parent") == F.col("x.parent")))
    beside = beside.select("o.conv_id", "o.turn", F.col("x.turn").alias("sibling"))

    n, r, b = nodes.alias("n"), first_reply.alias("r"), beside.alias("b")
    down = n.join(r, _same("n", "r") & (F.col("n.turn") == F.col("r.parent")), "left").select(
        "n.conv_id", "n.turn", F.lit(False).alias("up"), F.coalesce("first_reply", "n.turn").alias("next"), F.col("first_reply").isNull().alias("next_up")
    )
    up = n.join(b, _same("n", "b") & (F.col("n.turn") == F.col("b.turn")), "left").select(
        "n.conv_id", "n.turn", F.lit(True).alias("up"), F.coalesce("sibling", "n.parent").alias("next"), F.col("sibling").isNull().alias("next_up")
    )
    walk = down.unionByName(up)
    walk = stored(walk.withColumn("steps", F.when(F.col("next").isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long")))
    while not walk.where("next is not null").isEmpty():
        # What has come to the end of its walk moves no more; every other step has one successor.
        a, z = walk.where("next is not null").alias("a"), walk.alias("z")
        met = a.join(z, _same("a", "z") & (F.col("a.next") == F.col("z.turn")) & (F.col("a.next_up") == F.col("z.up")))
        moved = met.select("a.conv_id", "a.turn", "a.up", "z.next", "z.next_up", (F.col("a.steps") + F.col("z.steps")).alias("steps"))
        walk = stored(walk.where("next is null").unionByName(moved))
    left = walk.where("not up").select("conv_id", "turn", "steps")
    w, f = left.alias("w"), left.alias("f")
    # A walk that is ``steps`` long and ends ``depth`` deep has gone down into half of both.
    return (
        n.join(w, _same("n", "w") & (F.col("n.turn") == F.col("w.turn")))
        .join(f, _same("n", "f") & (F.col("n.thread") == F.col("f.turn")))
        .select("n.conv_id", "n.turn", F.floor((F.col("f.steps") - F.col("w.steps") + F.col("n.depth")) / 2).alias("place"))
    )


def reply_ordered(table: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, quote_depth, reply_to, thread, depth, place for every row, in reply order."""
    said = messages(table)
    at = threads(reply_links(said))
    m, r, p = said.drop("lines").alias("m"), at.alias("r"), places(at).alias("p")
    return (
        m.join(r, _same("m", "r") & (F.col("m.turn") == F.col("r.turn")), "left")
        .join(p, _same("m", "p") & (F.col("m.turn") == F.col("p.turn")), "left")
        .select(
            "m.*", "r.reply_to", F.coalesce("r.thread", "m.turn").alias("thread"), F.coalesce("r.depth", F.lit(0).cast("long")).alias("depth"),
            F.coalesce("p.place", F.lit(0).cast("long")).alias("place"),
        )
        .orderBy("conv_id", "thread", "place", "turn")
    )


def chat_text(ordered: DataFrame) -> DataFrame:
    """``ordered`` with each message as a line of a chat transcript in column ``chat``."""
    return ordered.withColumn("chat", F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("text"), F.lit("\n")))


def op5_quote_links(spark, folder: str) -> DataFrame:
    return chat_text(reply_ordered(read(spark, folder, "conversations")))
