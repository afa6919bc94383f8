"""Chat formatting after collapsing cumulative snapshots.

A log often holds a conversation several times, each time a few turns longer. Every turn
has a hash of turn number, role and text; the running exclusive-or of two such hashes is
the hash of the prefix that ends there. A conversation whose whole hash (with its number
of rows) is the hash of a proper prefix of another is dropped by an anti-join; of equal
conversations the smallest id stays. What stays is rendered.

Running hashes are formed in blocks of turn numbers and carried over the blocks, so a
conversation with very many turns is not one window; rendering makes one row per
``PART_TURNS`` turn numbers. Prefix hashes are made distinct before they meet.

Cases: a row that repeats another of its conversation counts once; rows that share a
turn number form one step, rendered by role and text; null turns come first; a null
role or text differs from an empty one and is rendered empty; null ids form one
conversation; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_TURNS = 1024
PART_TURNS = 256
#: Fixed frame of a rendered turn.
TURN = ("<|im_start|>", "\n", "<|im_end|>\n")


def _block(turn: Column, size: int) -> Column:
    return F.floor(F.coalesce(turn, F.lit(-(1 << 62))) / F.lit(size)).cast("long")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, turn, x, y, n (hashes and rows up to the turn), total (rows of the conversation)."""
    row = [c for name in ("turn", "role", "text") for c in (F.col(name), F.col(name).isNull())]
    steps = (
        turns.select("conv_id", "turn", F.xxhash64(F.lit(1), *row).alias("x"), F.xxhash64(F.lit(2), *row).alias("y"))
        .distinct().groupBy("conv_id", "turn").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.count("*").alias("n"))
        .withColumn("block", _block(F.col("turn"), BLOCK_TURNS))
    )
    blocks = steps.groupBy("conv_id", "block").agg(F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by"), F.sum("n").alias("bn"))
    ahead = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.bit_xor("bx").over(ahead), F.lit(0)).alias("px"),
        F.coalesce(F.bit_xor("by").over(ahead), F.lit(0)).alias("py"), F.coalesce(F.sum("bn").over(ahead), F.lit(0)).alias("pn"),
        F.sum("bn").over(Window.partitionBy("conv_id")).alias("total"))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    running = steps.select("conv_id", "turn", "block", *(f(c).over(inside).alias(c) for f, c in ((F.bit_xor, "x"), (F.bit_xor, "y"), (F.sum, "n"))))
    carried = running.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    return carried.select(
        "conv_id", "turn", F.col("x").bitwiseXOR(F.col("px")).alias("x"), F.col("y").bitwiseXOR(F.col("py")).alias("y"),
        (F.col("n") + F.col("pn")).alias("n"), "total")


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id (renamed kept_id), copies: conversations that no longer one begins with."""
    steps = prefixes(turns)
    whole = steps.filter("n = total").groupBy("x", "y", "n").agg(F.min("conv_id").alias("kept_id"), F.count("*").alias("copies"))
    inner = steps.filter("n < total").select("x", "y", "n").distinct()
    return whole.join(inner, ["x", "y", "n"], "left_anti").select("kept_id", "copies")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, rendered."""
    start, between, end = map(F.lit, TURN)
    row = F.struct(F.col("turn"), F.col("role"), F.col("text"))
    parts = turns.groupBy("conv_id", _block(F.col("turn"), PART_TURNS).alias("part")).agg(F.sort_array(F.collect_set(row)).alias("rows"))
    lines = F.transform("rows", lambda r: F.concat(start, F.coalesce(r["role"], F.lit("")), between, F.coalesce(r["text"], F.lit("")), end))
    return parts.select("conv_id", "part", F.size("rows").cast("long").alias("n_turns"), F.array_join(lines, "").alias("rendered"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, rendered, copies of the maximal conversations."""
    turns = conversations.select("conv_id", "turn", "role", "text")
    kept = maximal_conversations(turns)
    own = turns.join(kept.select("kept_id"), F.col("conv_id").eqNullSafe(F.col("kept_id")), "left_semi")
    return render(own).join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id"))).drop("kept_id")
