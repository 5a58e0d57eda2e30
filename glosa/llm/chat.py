"""Operator 1: chat formatting of logged conversations without their snapshots.

A log holds the same conversation again and again as it grows. A turn's prefix
hash is the running XOR of hashes of (place, role, text) over the turns up to
it, 128 bits from two seeds: equal hashes mean equal prefixes. A conversation
whose whole hash is the prefix hash of a longer one is a snapshot of that and
is dropped by an anti-join; of equal conversations the least id stays. What
remains is rendered as one text.

Prefixes and whole conversations are grouped by hash before they meet, so a
first turn or conversation that very many logs share is one row there.

Built-in functions only. Turns go by number, then role and text (nulls last);
repeated rows of a turn count once; a null role is "unknown", a null text
empty. Rows without a conv_id are one-turn conversations of their own, equal
ones once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glosa.llm.common import stored

OPEN, CLOSE, UNKNOWN = "<|im_start|>", "<|im_end|>", "unknown"


def hashed_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, lone (hash of a row without a conversation), turn, role, text, place and the prefix hashes p1, p2."""
    turns = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
                         F.coalesce(F.col(role_col), F.lit(UNKNOWN)).alias("role"),
                         F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    turns = turns.withColumn("lone", F.when(F.col("conv").isNull(), F.sha2(F.concat_ws("\x00", "role", "text"), 256)))
    turns = turns.withColumn("turn", F.when(F.col("lone").isNull(), F.col("turn"))).distinct()
    order = W.partitionBy("conv", "lone").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    turns = turns.withColumn("place", F.row_number().over(order))
    # Hash columns before the window, so that texts need not be kept in order twice.
    to_here = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    return turns.select("*", F.bit_xor(F.xxhash64("place", "role", "text")).over(to_here).alias("p1"),
                        F.bit_xor(F.xxhash64("text", "place", F.lit(1), "role")).over(to_here).alias("p2"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv, lone, n_turns and n_copies of the conversations that no longer one begins with; equal ones once."""
    last = prefixes.groupBy("conv", "lone").agg(F.max(F.struct("place", "p1", "p2")).alias("end"))
    whole = last.select("conv", "lone", "end.*").groupBy("place", "p1", "p2").agg(
        F.min(F.struct(F.col("conv").isNull().alias("none"), "conv", "lone")).alias("first"),
        F.count(F.lit(1)).alias("n_copies"))
    ends = last.select("conv", "lone", F.col("end.place").alias("n"))
    inner = (prefixes.join(ends, prefixes["conv"].eqNullSafe(ends["conv"]) & prefixes["lone"].eqNullSafe(ends["lone"]))
             .where("place < n").select("place", "p1", "p2").distinct())
    return (whole.join(inner, ["place", "p1", "p2"], "left_anti")
            .select("first.conv", "first.lone", F.col("place").alias("n_turns"), "n_copies"))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE + "\n"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """One row per maximal conversation: its id, n_turns, n_copies and the rendered ``chat``.

    An empty table gives no rows.
    """
    turns = hashed_turns(turns, conv_col, turn_col, role_col, text_col)
    prefixes = stored(turns.select("conv", "lone", "place", "p1", "p2"), "prefixes")
    kept = stored(maximal(prefixes), "maximal")
    left = turns.select("conv", "lone", "place", "role", "text")
    left = left.join(kept.withColumnsRenamed({"conv": "kc", "lone": "kl"}),
                     F.col("conv").eqNullSafe(F.col("kc")) & F.col("lone").eqNullSafe(F.col("kl")))
    # A group is one conversation, which becomes one text.
    parts = F.array_sort(F.collect_list(F.struct("place", render(F.col("role"), F.col("text")).alias("part"))))
    out = left.groupBy("conv", "lone", "n_turns", "n_copies").agg(parts.alias("parts"))
    return out.select(F.col("conv").alias(conv_col), F.col("n_turns").cast("long").alias("n_turns"), "n_copies",
                      F.array_join(F.transform("parts", lambda p: p.part), "").alias("chat"))
