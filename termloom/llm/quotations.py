"""Quotation linking: nested quotes to the messages they come from, and conversations in reply order.

A line's quote level is the number of marks ">" at its start. A passage is what a line says without
them; normalised (lower case, runs of blanks as one space, trimmed) and hashed, the quoted passages of a
message are joined to the first message of the conversation that says the same unquoted. If that is an
earlier message it is the passage's original. A message replies to the message that is the original of
most of its passages at level one (the latest of those with equally many), and belongs to the
thread of the message it replies to; one that replies to none begins a thread. In the order of (conversation,
thread, turn) every message comes after the one it replies to. Threads are found by pointer doubling: as
many rounds as the logarithm of the longest chain of replies.

Only the first message for each passage of a conversation is joined, so a passage that many
messages share gives one row for each quote of it, never pairs.

Defined cases: a null text is empty; messages with a null conversation or turn neither reply nor are
replied to and are threads of their own; rows that share (conversation, turn) are one message and have the
same reply, each with its own text; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import BLANK_RUN, text_of
from termloom.session import checkpointed

MARKS = r"^[ \t]*((?:>[ \t]*)*)"


def level(line: Column) -> Column:
    return F.char_length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def passage(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), BLANK_RUN, " "), F.lit(" "))


def lines_of(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, hash) of the lines that say something."""
    each = messages.select("conv_id", "turn", F.explode(F.split(text_of(), "\n", -1)).alias("line"))
    said = each.select("conv_id", "turn", level(F.col("line")).alias("level"), passage(F.col("line")).alias("said"))
    return said.filter("said <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL").select(
        "conv_id", "turn", "level", F.md5(F.encode("said", "UTF-8")).alias("hash")
    )


def quotes(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, hash, original): quoted passages; original is null if no earlier message says it."""
    lines = lines_of(messages)
    quoted = lines.filter("level > 0").groupBy("conv_id", "turn", "level", "hash").agg(F.count("*").alias("n"))
    first = lines.filter("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("said_at"))
    return quoted.join(first, ["conv_id", "hash"], "left").select(
        "conv_id", "turn", "level", "hash", F.when(F.col("said_at") < F.col("turn"), F.col("said_at")).alias("original")
    )


def threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, root, depth) of the messages that reply; parents are earlier turns."""
    found = checkpointed(replies.select("conv_id", "turn", "parent", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = found.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        further = found.join(up, ["conv_id", "root"], "left")
        if further.filter("_root IS NOT NULL").isEmpty():
            return found
        found = checkpointed(
            further.select(
                "conv_id", "turn", "parent", F.coalesce("_root", "root").alias("root"),
                (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
            )
        )


def linked(messages: DataFrame) -> DataFrame:
    """Per message: its text without quotes, the message it replies to, its thread and depth in it."""
    found = checkpointed(quotes(messages))
    votes = (
        found.filter("level = 1 AND original IS NOT NULL")
        .groupBy("conv_id", "turn", "original").agg(F.count("*").alias("n"))
        .groupBy("conv_id", "turn").agg(F.max(F.struct("n", "original"))["original"].alias("parent"))
    )
    replies = threads(votes)
    counts = found.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_quotes"), F.count("original").alias("n_linked"), F.max("level").cast("long").alias("max_level")
    )
    about = counts.join(replies, ["conv_id", "turn"], "left").withColumnsRenamed({"conv_id": "_conv", "turn": "_turn"})
    zero = F.lit(0).cast("long")
    own = F.filter(F.split(text_of(), "\n", -1), lambda x: level(x) == 0)
    said = messages.select("conv_id", "turn", "role", F.array_join(own, "\n").alias("own_text"))
    return said.join(about, (said.conv_id == F.col("_conv")) & (said.turn == F.col("_turn")), "left").select(
        "conv_id", F.coalesce("root", "turn").alias("thread"), "turn", "role", "own_text", F.col("parent").alias("reply_to"),
        F.coalesce("depth", zero).alias("depth"), F.coalesce("n_quotes", zero).alias("n_quotes"),
        F.coalesce("n_linked", zero).alias("n_linked"), F.coalesce("max_level", zero).alias("max_level"),
    )
