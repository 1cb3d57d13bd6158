"""Chat formatting: logged snapshots of a growing conversation collapse into the longest one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.llm.storage import stored


def _content(seed: int) -> Column:
    """A hash of a turn's role and text in which nulls differ from empty strings."""
    return F.xxhash64(F.lit(seed), F.col("role").isNull(), "role", F.col("text").isNull(), "text")


def _alone() -> Column:
    """What tells turns without a conv_id apart; null for the others."""
    return F.when(F.col("conv_id").isNull(), F.xxhash64(F.lit(3), "turn", F.col("role").isNull(), "role", F.col("text").isNull(), "text"))


def prefixes(turns: DataFrame) -> DataFrame:
    """turns -> (conv_id, alone, k, n, h, g): for each conversation of n turns, a 128-bit hash of its first k turns.

    The hash of a prefix rolls on turn by turn: it is the exclusive or of
    hashes of (place, role, text).  Turns are ordered by number, then role and
    text; equal rows are one turn.  A turn without a conv_id is a conversation
    of its own, so those that have none are no group.  Only hashes are
    shuffled; the turns of a conversation are sorted, never listed in one row.
    """
    once = turns.select("conv_id", _alone().alias("alone"), "turn", F.col("role").alias("r"), _content(1).alias("a"), _content(2).alias("b")).distinct()
    whole = Window.partitionBy("conv_id", "alone")
    order = whole.orderBy("turn", "r", "a", "b")
    placed = once.select("conv_id", "alone", "a", "b", (F.row_number().over(order) - 1).alias("k"), F.count("*").over(whole).cast("int").alias("n"))
    rolled = whole.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return placed.select(
        "conv_id", "alone", (F.col("k") + 1).alias("k"), "n",
        F.bit_xor(F.xxhash64("k", "a", "b")).over(rolled).alias("h"), F.bit_xor(F.xxhash64("b", "k", "a")).over(rolled).alias("g"),
    )


def maximal(turns: DataFrame) -> DataFrame:
    """turns -> (conv_id, alone, n): conversations that are no proper prefix of another, one of each set of equal ones.

    The smallest conv_id of equal conversations stays, nulls come last.  Whole conversations and proper prefixes are
    made distinct (pre-aggregated) before the anti-join, so a first turn that
    a third of all conversations share is one row there.
    """
    found = stored(prefixes(turns), "prefixes")
    whole = found.filter("k = n").groupBy("h", "g", "n").agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "alone")).alias("c"))
    shorter = found.filter("k < n").select("h", "g").distinct()
    return whole.join(shorter, ["h", "g"], "left_anti").select("c.conv_id", "c.alone", "n")


def render(turns: DataFrame) -> DataFrame:
    """turns -> (conv_id, n_turns, rendered): maximal conversations as one text each.

    A turn is written as <|role|>, a new line, its text, a new line and
    <|end|>; a null role is written "unknown" and a null text is empty.  "<|"
    in a text gets a blank between its characters, so that no text can forge a
    mark.  A turn with a null conv_id is a conversation of its own.  Texts of
    any length are written whole; a conversation is one text and so one row.
    Other columns are not looked at; no row gives an empty table.
    """
    kept = maximal(turns).select(F.col("conv_id").alias("_kept"), F.col("alone").alias("_alone"))
    own = turns.select("conv_id", _alone().alias("alone"), "turn", "role", "text")
    own = own.join(kept, own.conv_id.eqNullSafe(F.col("_kept")) & own.alone.eqNullSafe(F.col("_alone")), "left_semi")
    listed = own.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_set(F.struct("turn", "role", _content(1).alias("a"), _content(2).alias("b"), "text"))).alias("ts"))
    line = lambda t: F.concat(F.lit("<|"), F.coalesce(t.role, F.lit("unknown")), F.lit("|>\n"), F.replace(F.coalesce(t.text, F.lit("")), F.lit("<|"), F.lit("< |")), F.lit("\n<|end|>\n"))
    return listed.select("conv_id", F.size("ts").cast("long").alias("n_turns"), F.array_join(F.transform("ts", line), "").alias("rendered"))
