"""Chat formatting: collapse cumulative snapshots of conversations, then render the maximal ones.

A logging client often stores a conversation after every turn, so a log holds the same conversation at many lengths.
Each turn has a 2 x 44 bit hash of (rank, role, text); the sum over the first n turns is a rolling hash of the prefix, and a
conversation is dropped when its whole hash is a proper prefix's hash of a longer one, or when an equal one has a smaller
conv_id.  Sums aggregate before the shuffle, and running sums are taken in blocks of turns whose totals are added up
apart, so no conversation, first turn or group of equal conversations gathers its rows in one task.

A null role or text counts as empty and differs from no value; a null turn sorts first; a null conv_id is a conversation of
its own.  Repeated (conv_id, turn, role, text) rows count once; other ties of a turn go by role, then text.  An empty
table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

BLOCK = 256
_BITS = (1 << 44) - 1


def _ranked(conversations: DataFrame) -> DataFrame:
    """Distinct turns with their rank from 0 within the conversation."""
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(-(2**62))))
    inside = turns.withColumn("inner", F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")) - 1)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = inside.groupBy("conv_id", "block").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    out = inside.alias("a").join(
        sizes.alias("b"), (F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))) & (F.col("a.block") == F.col("b.block"))
    )
    return out.select("a.conv_id", "a.block", (F.col("inner") + F.col("before")).alias("rank"), "role", "text")


def prefix_hashes(ranked: DataFrame) -> DataFrame:
    """(conv_id, length, h1, h2) of every turn prefix."""
    h = ranked.select(
        "conv_id", "block", "rank",
        F.xxhash64(F.lit(1), "rank", "role", "text").bitwiseAND(_BITS).alias("a"),
        F.xxhash64(F.lit(2), "text", "role", "rank").bitwiseAND(_BITS).alias("b"),
    )
    run = Window.partitionBy("conv_id", "block").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    running = h.select("conv_id", "block", "rank", F.sum("a").over(run).alias("a"), F.sum("b").over(run).alias("b"))
    totals = h.groupBy("conv_id", "block").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    totals = totals.select("conv_id", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("ta", "tb")])
    out = running.alias("r").join(totals.alias("t"), F.col("r.conv_id").eqNullSafe(F.col("t.conv_id")) & (F.col("r.block") == F.col("t.block")))
    return out.select(
        "r.conv_id", (F.col("rank") + 1).alias("length"), (F.col("a") + F.col("ta")).alias("h1"), (F.col("b") + F.col("tb")).alias("h2")
    )


def maximal_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ranked turns, ids): ids has conv_id and n_turns of the conversations that no other one contains as a prefix."""
    ranked = written(_ranked(conversations), "turns")
    prefixes = written(prefix_hashes(ranked), "prefixes")
    lengths = prefixes.groupBy("conv_id").agg(F.max(F.struct("length", "h1", "h2")).alias("whole"))
    whole = lengths.select("conv_id", "whole.*")
    one_each = whole.groupBy("length", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = (
        prefixes.alias("p")
        .join(whole.select("conv_id", F.col("length").alias("full")).alias("w"), F.col("p.conv_id").eqNullSafe(F.col("w.conv_id")))
        .filter("p.length < w.full").select("p.length", "p.h1", "p.h2").distinct()
    )
    kept = one_each.join(proper, ["length", "h1", "h2"], "left_anti")
    return ranked, kept.select("conv_id", F.col("length").alias("n_turns"), "n_copies")


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_copies (equal conversations, itself included) and chat.

    A turn renders as ``<|role|>``, a newline, the text and a newline.
    """
    ranked, kept = maximal_conversations(conversations)
    piece = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n"))
    turns = ranked.alias("t").join(kept.alias("k"), F.col("t.conv_id").eqNullSafe(F.col("k.conv_id"))).select(
        "k.conv_id", "n_turns", "n_copies", F.struct("rank", piece.alias("piece")).alias("part")
    )
    chats = turns.groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return chats.select("conv_id", F.col("n_turns").cast("long"), F.col("n_copies").cast("long"), F.array_join("parts.piece", "").alias("chat"))
