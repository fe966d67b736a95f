"""Chat formatting by quotation linking.

Lines that begin with quote marks belong to a quoted passage at the level of their marks.
Quoted lines and the lines people wrote themselves are normalised and hashed; a message
answers the earlier message that wrote most of what it quotes.  Conversations come out in
reply order, without the quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import stage
from .components import components

MARKS = r"^((?:[ \t]*>)+)[ \t]?"
ATTRIBUTION = r"(?i)^\s*(?:on|am|le|el)\b.{1,200}\b(?:wrote|schrieb|a écrit|escribió)\s*:\s*$"
#: Normalised lines with fewer characters say too little to link by.
MIN_CHARS = 12
#: Turns of a conversation that one window orders about.
TURNS = 1024


def normal(body: Column) -> Column:
    """Letters and digits in lower case, runs of anything else as one space."""
    return F.trim(F.regexp_replace(F.lower(body), r"[^\p{L}\p{N}]+", " "))


def parsed(chats: DataFrame, text: str) -> DataFrame:
    """Add ``own`` (the text without quotes and their attributions), ``own_h`` (hashes of
    its lines), ``quoted`` (level and hash of each quoted line)."""
    d = chats.withColumn("_l", F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", ""))
    d = d.withColumn("_v", F.transform("_l", level))
    last = F.size("_v") - 1
    intro = lambda x, i: x.rlike(ATTRIBUTION) & (i < last) & (F.get("_v", i + 1) > F.get("_v", i))
    kept = F.filter("_l", lambda x, i: (F.get("_v", i) == 0) & ~intro(x, i))
    d = d.withColumn("_k", kept)
    long = lambda n: F.length(n) >= MIN_CHARS
    own = F.transform(F.filter(F.transform("_k", normal), long), lambda n: F.xxhash64(n))
    bodies = F.filter(F.transform("_l", lambda x, i: F.struct(F.get("_v", i).alias("level"), normal(F.regexp_replace(x, MARKS, "")).alias("n"))), lambda s: (s["level"] > 0) & long(s["n"]))
    quoted = F.transform(bodies, lambda s: F.struct(s["level"].alias("level"), F.xxhash64(s["n"]).alias("h")))
    d = d.withColumn("own_h", F.array_distinct(own)).withColumn("quoted", F.array_distinct(quoted))
    return d.withColumn("own", F.when(F.array_contains("_v", 0), F.trim(F.array_join("_k", "\n"))).otherwise("")).drop("_l", "_v", "_k")


def replies(messages: DataFrame) -> DataFrame:
    """(conv, turn, pconv, pturn, n_linked): the message each quoting message answers.

    A quoted line comes from the first message of the same conversation that wrote it, if
    that is earlier, else from the first one of an older conversation (a smaller id).  So
    a line that thousands wrote has one origin and makes no pairs.  The lowest quote level
    with an origin decides, then the number of lines, then the earliest origin.
    """
    q = messages.where(F.size("quoted") > 0).select("conv", "turn", F.explode_outer("quoted").alias("q")).select("conv", "turn", "q.level", "q.h").distinct()
    q = stage(q)
    wanted = q.select("h").distinct()
    own = messages.select("conv", "turn", F.explode_outer("own_h").alias("h")).where("h is not null and conv is not null and turn is not null").join(wanted, "h", "left_semi")
    own = stage(own)
    here = own.groupBy("conv", "h").agg(F.min("turn").alias("hturn"))
    ever = own.groupBy("h").agg(F.min(F.struct("conv", "turn")).alias("e"))
    d = q.join(here, ["conv", "h"], "left").join(ever, "h", "left")
    near = F.when(F.col("hturn") < F.col("turn"), F.struct("conv", F.col("hturn").alias("turn")))
    far = F.when(F.col("e.conv") < F.col("conv"), F.col("e"))
    votes = d.withColumn("p", F.coalesce(near, far)).where("p is not null").groupBy("conv", "turn", "level", "p").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("conv", "turn").agg(F.min(F.struct("level", (-F.col("n")).alias("less"), "p")).alias("b"))
    return best.select("conv", "turn", F.col("b.p.conv").alias("pconv"), F.col("b.p.turn").alias("pturn"), (-F.col("b.less")).alias("n_linked"))


def conversations(chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conversation, turn, role, ``text`` without quotes,
    ``parent_conv`` and ``parent_turn`` (null where nothing was quoted from an earlier
    message), ``n_quoted`` and ``n_linked`` lines, ``thread_id`` (the least conversation
    joined with it by replies) and ``position`` (from 0 in its conversation).  By
    (thread_id, conversation, position) every message follows the one it answers.

    A null text is empty; rows with a null conversation or turn answer nothing and order
    first; repeated rows keep their place each; a message of quotes alone has an empty
    text; an empty table gives an empty table; other columns are not read.
    """
    d = chats.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    d = stage(parsed(d, "text").drop("text"))
    found = stage(replies(d))
    links = found.where("pconv != conv").select(F.col("conv").alias("a"), F.col("pconv").alias("b"))
    threads = components(links).withColumnsRenamed({"node": "conv", "root": "thread"})

    d = d.withColumn("_b", F.floor(F.col("turn") / TURNS))
    totals = d.groupBy("conv", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("conv").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    first = totals.select(F.col("conv").alias("_c"), F.col("_b").alias("_d"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    d = d.withColumn("_in", F.row_number().over(W.partitionBy("conv", "_b").orderBy("turn", "role", "own")) - 1)
    d = d.join(first, d["conv"].eqNullSafe(F.col("_c")) & d["_b"].eqNullSafe(F.col("_d")))
    d = d.join(found, ["conv", "turn"], "left").join(threads, "conv", "left")
    return d.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("own").alias("text"),
        F.col("pconv").alias("parent_conv"), F.col("pturn").alias("parent_turn"), F.size("quoted").cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.coalesce("thread", "conv").alias("thread_id"), (F.col("_first") + F.col("_in")).cast("long").alias("position"),
    )
