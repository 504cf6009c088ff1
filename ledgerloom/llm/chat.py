"""Operator 1, chat formatting: quotation linking, by DataFrame functions alone.

A line's quote level is the number of ``>`` that it begins with. A passage is a paragraph of a message: neighbouring lines of one
level up to a blank one, joined, so that wrapping does not matter, in lower case with one blank between words. Its hashes are those
of its runs of 5 words; a passage of fewer words has one, of the whole. Own passages (level 0) are hashed alike, and their short
lines and sentences too. The original of a hash is the earliest message of the conversation whose own text has it. A quoted
passage is linked to the message before it that holds the originals of most of its hashes (ties: the later one), if
of at least half. A message replies to the message that most hashes of its linked passages of the lowest level lead to.

Messages that reply to none begin threads. ``position`` numbers a conversation's messages in reply order: threads by their first turn,
in a thread each message before its replies, replies by turn with all that hangs on them. The text keeps own lines
only, without a line that announces a quotation ("On ... wrote:") in messages that quote; quotes without an original go too.

Null texts are empty. A null conv_id or turn takes no part in links: such a row begins a thread of its own. Rows that share
conv_id and turn are one node of a thread, and each keeps its row. Extra columns are not read. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, maybe_in, running_total

SALTS = 8
RUN = 5
MARKS = r"^(?:[ \t]*+>)*+"
QUOTES = r"(?m)^[ \t]*+>"
BREAK = "\r\n|\n|\r"
ANNOUNCES = r"(?i)^(?:on\b.*\bwrote|.*\bwrites?):$"
SENTENCE = r"(?<=[.!?…。！？])\s+"


def plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def runs(passage: Column) -> Column:
    """The distinct hashes of a passage's runs of words; of the whole if it is short; none if it is empty."""
    words = F.split(passage, " ")
    many = F.transform(F.sequence(F.lit(1), F.size(words) - RUN + 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i, RUN), " ")))
    return F.when(passage == "", F.array().cast("array<long>")).when(F.size(words) < RUN, F.array(F.xxhash64(passage))).otherwise(F.array_distinct(many))


def passages(messages: DataFrame) -> DataFrame:
    """row, conv_id, turn, p, level, passage, lines: the paragraphs of each message, without empty ones."""
    each = messages.select("row", "conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), BREAK)).alias("n", "line"))
    marks = F.regexp_extract("line", MARKS, 0)
    each = each.withColumn("level", F.length(F.regexp_replace(marks, "[^>]", ""))).withColumn("body", plain(F.regexp_replace("line", MARKS, "")))
    line = Window.partitionBy("row").orderBy("n")
    new = (F.col("level") != F.lag("level").over(line)) | (F.lag("body").over(line) == "")
    each = each.withColumn("p", F.sum(F.coalesce(new.cast("int"), F.lit(0))).over(line)).where("body <> ''")
    held = each.groupBy("row", "conv_id", "turn", "p", "level").agg(F.array_sort(F.collect_list(F.struct("n", "body"))).alias("l"))
    return held.select("row", "conv_id", "turn", "p", "level", F.array_join("l.body", " ").alias("passage"), F.col("l.body").alias("lines"))


def short(passage: Column, lines: Column) -> Column:
    """The hashes of the lines and sentences that have fewer words than a run."""
    few = F.filter(F.array_union(lines, F.split(passage, SENTENCE)), lambda s: (F.size(F.split(s, " ")) < RUN) & (s != ""))
    return F.transform(few, lambda s: F.xxhash64(s))


def replies(messages: DataFrame) -> DataFrame:
    """row, conv_id, turn, n_quoted, max_level, n_linked, reply_to of each message that quotes; messages: row, conv_id, turn, text."""
    quoting = messages.where(F.col("text").rlike(QUOTES))
    quoted = cut(passages(quoting).where("level > 0").select("row", "conv_id", "turn", "p", "level", runs(F.col("passage")).alias("hashes")), "quoted")
    facts = quoted.groupBy("row", "conv_id", "turn").agg(F.count("*").alias("n_quoted"), F.max("level").alias("max_level"))
    asked = quoted.where("conv_id is not null and turn is not null").select("row", "conv_id", "turn", "p", "level", F.size("hashes").alias("n"), F.explode("hashes").alias("hash"))
    # Only conversations that quote are read for originals.
    convs = asked.select("conv_id").distinct()
    known = passages(maybe_in(messages, "conv_id", convs).where("turn is not null").join(convs, "conv_id", "left_semi")).where("level = 0")
    known = known.select("conv_id", F.col("turn").alias("own"), F.explode(F.array_union(runs(F.col("passage")), short(F.col("passage"), F.col("lines")))).alias("hash"))
    both = known.select("conv_id", "hash", "own", F.lit(False).alias("asked")).union(asked.select("conv_id", "hash", F.lit(None).cast("long"), F.lit(True)))
    first = both.groupBy("conv_id", "hash").agg(F.min("own").alias("original"), F.max("asked").alias("asked")).where("asked and original is not null")
    first = first.select("conv_id", "hash", "original", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = asked.withColumn("salt", F.pmod(F.xxhash64("row", "p"), F.lit(SALTS)).cast("int")).join(first, ["conv_id", "hash", "salt"]).where("original < turn")
    votes = met.groupBy("row", "conv_id", "turn", "p", "level", "n", "original").agg(F.count("*").alias("k"))
    linked = votes.groupBy("row", "conv_id", "turn", "p", "level", "n").agg(F.max(F.struct("k", "original")).alias("best")).where("2 * best.k >= n")
    linked = linked.select("row", "conv_id", "turn", "level", F.col("best.k").alias("k"), F.col("best.original").alias("original"))
    score = linked.groupBy("row", "conv_id", "turn", "level", "original").agg(F.sum("k").alias("k"), F.count("*").alias("c"))
    choice = score.groupBy("row").agg(F.sum("c").alias("n_linked"), F.min(F.struct("level", -F.col("k"), -F.col("original")))["col3"].alias("best"))
    return facts.join(choice, "row", "left").select("row", "conv_id", "turn", "n_quoted", "max_level", "n_linked", (-F.col("best")).alias("reply_to"))


def places(edges: DataFrame) -> DataFrame:
    """conv_id, turn, root, depth, place of every message of a thread with replies; edges: conv_id, turn, reply_to.

    A walk enters each message before its replies and leaves it after them; place is how many it has entered before. The
    walk's steps double each round, so a thread of n messages takes log2(2 n) rounds.
    """
    up = cut(edges.select("conv_id", "turn", F.col("reply_to").alias("root"), F.lit(1).cast("long").alias("depth")), "up")
    while True:
        above = up.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("r"), F.col("depth").alias("d"))
        if not up.join(above, ["conv_id", "root"], "left_semi").take(1):
            break
        up = cut(up.join(above, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("r", "root").alias("root"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth")), "up")
    nodes = up.union(up.select("conv_id", "root", "root", F.lit(0).cast("long")).distinct())

    ranked = cut(running_total(edges, ["conv_id", "reply_to"], ["turn"], name="k").select("conv_id", "turn", "reply_to", "k"), "ranked")
    after = ranked.select("conv_id", "reply_to", (F.col("k") - 1).alias("k"), F.col("turn").alias("sibling"))
    first = ranked.where("k = 0").select("conv_id", F.col("reply_to").alias("turn"), F.col("turn").alias("child"))
    enter, leave = (lambda c: F.col(c) * 2), (lambda c: F.col(c) * 2 + 1)
    down = nodes.join(first, ["conv_id", "turn"], "left").select("conv_id", enter("turn").alias("at"), F.coalesce(enter("child"), leave("turn")).alias("to"), F.lit(1).cast("long").alias("w"))
    back = ranked.join(after, ["conv_id", "reply_to", "k"], "left").select("conv_id", leave("turn").alias("at"), F.coalesce(enter("sibling"), leave("reply_to")).alias("to"), F.lit(0).cast("long").alias("w"))
    ends = nodes.where("depth = 0").select("conv_id", leave("turn").alias("at"), F.lit(None).cast("long").alias("to"), F.lit(0).cast("long").alias("w"))
    walk = cut(down.union(back).union(ends), "walk")
    while walk.where("to is not null").take(1):
        ahead = walk.select("conv_id", F.col("at").alias("to"), F.col("to").alias("next"), F.col("w").alias("v"))
        walk = cut(walk.join(ahead, ["conv_id", "to"], "left").select("conv_id", "at", F.col("next").alias("to"), (F.col("w") + F.coalesce("v", F.lit(0))).alias("w")), "walk")
    left = walk.where("at % 2 = 0").select("conv_id", F.shiftright("at", 1).alias("turn"), "w")
    of_root = left.select("conv_id", F.col("turn").alias("root"), F.col("w").alias("all"))
    return nodes.join(left, ["conv_id", "turn"]).join(of_root, ["conv_id", "root"]).select("conv_id", "turn", "root", "depth", (F.col("all") - F.col("w")).alias("place"))


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, n_quoted, max_level, n_linked, reply_to, root_turn, depth, position, text: one row for each message."""
    messages = cut(messages.select("conv_id", "turn", "role", "text").withColumn("row", F.monotonically_increasing_id()), "messages")
    told = cut(replies(messages), "replies")
    edges = told.where("reply_to is not null").groupBy("conv_id", "turn").agg(F.max("reply_to").alias("reply_to"))
    known = cut(places(edges), "places")

    kept = F.filter(F.split(F.coalesce("text", F.lit("")), BREAK), lambda x: ~x.rlike(r"^[ \t]*>"))
    quotes = F.coalesce(F.col("n_quoted"), F.lit(0)) > 0
    body = F.trim(F.array_join(F.filter(kept, lambda x: ~F.trim(x).rlike(ANNOUNCES)), "\n"))
    j = messages.join(told.drop("conv_id", "turn"), "row", "left").join(known, ["conv_id", "turn"], "left")
    zero = lambda c, kind="long": F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    out = j.select("row", "conv_id", "turn", "role", zero("n_quoted"), zero("max_level", "int"), zero("n_linked"), "reply_to", F.coalesce("root", "turn").alias("root_turn"), zero("depth", "int"), zero("place"), F.when(quotes, body).otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    # Texts stay where they are; only the numbers are dealt by range.
    narrow = out.select("row", "conv_id", "root_turn", "place")
    position = cut(running_total(narrow, ["conv_id"], ["root_turn", "place", "row"], name="position").select("row", "position"), "positions")
    return out.join(position, "row").drop("row", "place")
