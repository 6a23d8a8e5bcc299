"""Logged chats: snapshots that are prefixes of longer ones collapse into the longest, which is then rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.store import Scratch


def _turn_digest() -> Column:
    """A digest of a turn's role and text in which null, empty and shifted boundaries all differ."""
    part = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), c))
    return F.concat(part(F.col("role")), F.lit("|"), part(F.col("text")))


def _turns(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, k, n, a, b): the hash (a, b) of each conversation's first k of n turns.

    Turns are ordered by turn, then role, then text (nulls first); exact repeats of a (conv_id, turn, role, text) row
    count once. Rows with a null conv_id form one conversation. The hash rolls: each turn's digest, which includes its
    position, is added by xor to that of the turns before, so the work is one sort and grows with the turns alone, and
    a very long conversation spills instead of filling a row.
    """
    own = Window.partitionBy("conv_id")
    placed = _turns(turns).withColumn("k", F.dense_rank().over(own.orderBy("turn", "role", "text")).cast("long"))
    digest = F.sha2(F.concat(F.col("k").cast("string"), F.lit("/"), _turn_digest()), 256)
    once = placed.select("conv_id", "k", digest.alias("digest")).groupBy("conv_id", "k").agg(F.min("digest").alias("digest"))
    part = lambda at: F.conv(F.substring("digest", at, 16), 16, -10).cast("long")
    rolling = own.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return once.select("conv_id", "k", F.max("k").over(own).alias("n"), F.bit_xor(part(1)).over(rolling).alias("a"), F.bit_xor(part(17)).over(rolling).alias("b"))


def render(turns: Column, start: str = "<|im_start|>", end: str = "<|im_end|>") -> Column:
    """A conversation's text: each turn between markers, its role on the first line; null parts are empty."""
    shown = F.transform(turns, lambda t: F.concat(F.lit(start), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(f"{end}\n")))
    return F.concat_ws("", shown)


def collapse(turns: DataFrame) -> DataFrame:
    """The maximal conversations, rendered.

    A conversation goes if its turns (role and text, in order) are a proper prefix of another's, or equal another's
    that has a smaller conv_id (null is the smallest). Returns conv_id, n_turns, n_copies (conversations with equal
    turns) and rendered. Equal conversations meet in a sum that is combined before the shuffle, so a very common
    conversation or first turn makes no large group. Only kept conversations are gathered, each into the one text that
    it becomes.
    """
    every = Scratch(turns.sparkSession).put(prefixes(turns), "prefixes")
    key = ["k", "a", "b"]
    distinct = (
        every.filter("k = n")
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("n_copies"), F.min(F.struct(F.col("conv_id").isNotNull().alias("known"), "conv_id")).alias("first"))
        .select(*key, "n_copies", F.col("first.conv_id").alias("kept_id"))
    )
    kept = distinct.join(every.filter("k < n").select(*key).distinct(), key, "left_anti").select("kept_id", F.col("k").alias("n_turns"), "n_copies")
    rows = _turns(turns).join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")))
    whole = rows.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    return whole.select("conv_id", "n_turns", "n_copies", render(F.col("turns")).alias("rendered"))
