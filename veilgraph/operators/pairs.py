"""Pairs of rows: sampled ones for the constraint statistics, and all that violate a constraint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.functions.expressions import hashed_number, holds, valid
from veilgraph.store import Scratch

Predicate = tuple[int, str, str, int, str]
#: So many keys and numbers (about 16 bytes each) are sent to every task at most.
MOST_SENT = 2_000_000
#: Rows of a side that meet in a task where all pairs are compared.
BLOCK = 50_000


def numbered(rows: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(key, rn): the distinct non-null keys with a dense number from 0 in their order. No task sees all of them.

    Ranges of keys are sorted apart and written, so that the ranges that are counted are the very ranges that are placed; only the
    key column is read, moved and written.
    """
    dealt = rows.select(key).filter(F.col(key).isNotNull()).repartitionByRange(key).dropDuplicates([key]).sortWithinPartitions(key)
    place = F.monotonically_increasing_id()
    dealt = scratch.put(dealt.select(key, F.shiftright(place, 33).alias("__p"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("__i")), "numbered")
    sizes = dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.join(F.broadcast(sizes.select("__p", before.alias("__base"))), "__p")  # a row for each range
    return placed.select(key, (F.col("__i") + F.col("__base")).alias("rn"))


def sample_pairs(rows: DataFrame, key: str, size: int, seed: int = 7) -> DataFrame:
    """``size`` ordered pairs of different rows, uniform and repeatable: (pair, l_*, r_*).

    Pair p takes the rows whose numbers are md5 of (seed, p) modulo n, and one of the n - 1 others. ``key`` names the rows: those
    without a key take no part, and of several with one key any stands for all. The keys are numbered alone; the rows
    are read once more for the at most 2 * size keys that were drawn, which are sent to every task if they are few.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    own = numbered(rows, key, scratch)
    n = own.count()
    if n < 2:
        raise ValueError("a pair needs two rows")
    left = F.pmod(hashed_number(F.lit(str(seed)), F.lit("l"), F.col("pair").cast("string")), F.lit(n))
    step = F.pmod(hashed_number(F.lit(str(seed)), F.lit("r"), F.col("pair").cast("string")), F.lit(n - 1)) + 1
    ids = spark.range(size).select(F.col("id").alias("pair")).withColumn("i", left).withColumn("j", F.pmod(F.col("i") + step, F.lit(n)))
    some = F.broadcast if size <= MOST_SENT // 2 else lambda df: df
    drawn = own.join(some(ids.select(F.col("i").alias("rn")).union(ids.select("j")).distinct()), "rn")
    drawn = scratch.put(drawn, "drawn")
    picked = scratch.put(rows.join(some(drawn), key).dropDuplicates([key]), "picked")
    side = lambda p: picked.select(F.col("rn").alias(f"{p}rn"), *[F.col(c).alias(f"{p}{c}") for c in rows.columns])
    return ids.join(side("l_"), F.col("i") == F.col("l_rn")).join(side("r_"), F.col("j") == F.col("r_rn")).drop("i", "j", "l_rn", "r_rn")


def sides(predicate: Predicate) -> tuple[Column, Column]:
    i1, c1, _, i2, c2 = predicate
    return F.col(("l_", "r_")[i1] + c1), F.col(("l_", "r_")[i2] + c2)


def predicate_columns(dc: list[Predicate]) -> tuple[Column, list[Column]]:
    """Whether a pair has all values that a constraint needs, and whether each predicate holds (false where it can't tell)."""
    both = [sides(p) for p in dc]
    return valid(*[s for pair in both for s in pair]), [F.coalesce(holds(a, p[2], b), F.lit(False)) for p, (a, b) in zip(dc, both, strict=True)]


def violations(rows: DataFrame, key: str, dc: list[Predicate]) -> DataFrame:
    """(l_key, r_key) of all ordered pairs of different rows that fulfil every predicate.

    Equality predicates across the rows become join keys, so Catalyst hashes or sorts on them. A constraint without any compares all pairs,
    which takes time by the square of the rows: the left rows are dealt over tasks, and each meets the right rows, sent along if they are few,
    else in blocks of ``BLOCK``, so that no task holds more than a block.
    """
    used = sorted({p[1] for p in dc} | {p[4] for p in dc})
    equal = [p for p in dc if p[2] in ("==", "=", "EQUAL") and p[0] != p[3]]
    side = lambda p: rows.select(F.col(key).alias(f"{p}key"), *[F.col(c).alias(f"{p}{c}") for c in used])
    tests = [holds(sides(p)[0], p[2], sides(p)[1]) for p in dc]
    condition = reduce(Column.__and__, tests) & (F.col("l_key") != F.col("r_key"))
    left, right = side("l_"), side("r_")
    if not equal:
        n = rows.count()
        parts = max(2 * rows.sparkSession.sparkContext.defaultParallelism, n // 5_000) if n > 2_000 else 1
        if n <= MOST_SENT // 4:
            left, right = left.repartition(parts) if parts > 1 else left, F.broadcast(right)
        else:
            blocks = 1 + n // BLOCK
            each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
            own = lambda p: F.pmod(F.xxhash64(*[f"{p}{c}" for c in ("key", *used)]), F.lit(blocks)).cast("int")
            left, right = left.withColumn("__i", own("l_")).withColumn("__j", each), right.withColumn("__j", own("r_")).withColumn("__i", each)
            return left.repartition(blocks * blocks, "__i", "__j").join(right.repartition(blocks * blocks, "__i", "__j"), ["__i", "__j"]).filter(condition).select("l_key", "r_key")
    return left.join(right, condition).select("l_key", "r_key")
