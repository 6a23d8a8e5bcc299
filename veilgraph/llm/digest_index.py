"""Exact dedup against a minimal perfect hash over the distinct digests of the past.

A shard of the index is one row: bit levels that give each of its digests a slot of its own, without a gap, and the slots,
which hold the full digest, the winner's locator and the group's size. Level by level every digest still without a slot marks a
hashed bit; one that is alone on its bit stays there, the others go on. A slot is the rank of a digest's bit among all set bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgraph.llm._text import mix
from veilgraph.store import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a level for each digest that reaches it.
_ROOM = 2


def _words(digests: pa.Array) -> np.ndarray:
    """SHA-256 digests as rows of four numbers."""
    return np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 4)


def _bit(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit of a level that a digest marks."""
    return (mix(words[:, 0] + np.uint64(level) * (words[:, 1] | np.uint64(1))) % np.uint64(size)).astype(np.int64)


def perfect_levels(words: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(bits of each level, all levels' bits, each digest's slot) of distinct digests."""
    sizes: list[int] = []
    levels: list[np.ndarray] = []
    place = np.zeros(len(words), np.int64)
    left, base = np.arange(len(words)), 0
    while len(left):
        size = max(8, _ROOM * len(left))
        bit = _bit(words[left], len(sizes), size)
        alone = np.bincount(bit, minlength=size) == 1
        stays = alone[bit]
        place[left[stays]] = base + bit[stays]
        sizes.append(size)
        levels.append(alone)
        left, base = left[~stays], base + size
    bits = np.concatenate(levels) if levels else np.zeros(0, bool)
    return sizes, bits, np.cumsum(bits)[place] - 1


def slots_of(words: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The only slot that a digest can have; -1 if it marks no set bit."""
    rank = np.cumsum(bits)
    found = np.full(len(words), -1, np.int64)
    left, base = np.arange(len(words)), 0
    for level, size in enumerate(sizes):
        bit = base + _bit(words[left], level, size)
        hit = bits[bit]
        found[left[hit]] = rank[bit[hit]] - 1
        left, base = left[~hit], base + size
    return found


def digest_index(past: DataFrame) -> DataFrame:
    """The index, a row for each shard: shard, sizes and bits of the levels, slots. ``past``: shard, digest (distinct), winner, n.

    The caller deals the shards: each is built, kept and read by one task.
    """
    slot_type = T.StructType([past.schema[c] for c in ("digest", "winner", "n")])
    schema = T.StructType([past.schema["shard"], T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("bits", T.BinaryType()), T.StructField("slots", T.ArrayType(slot_type))])

    def build(rows: pa.Table) -> pa.Table:
        sizes, bits, slot = perfect_levels(_words(rows.column("digest")))
        by_slot = np.empty(len(slot), np.int64)
        by_slot[slot] = np.arange(len(slot))
        held = pa.StructArray.from_arrays([rows.column(c).combine_chunks().take(pa.array(by_slot)) for c in slot_type.names], slot_type.names)
        return pa.table(
            [rows.column("shard").slice(0, 1), pa.array([sizes], pa.list_(pa.int32())), pa.array([np.packbits(bits).tobytes()]), pa.ListArray.from_arrays(pa.array([0, len(slot)], pa.int32()), held)],
            names=schema.names,
        )

    return past.groupBy("shard").applyInArrow(build, schema)


def looked_up(batch: DataFrame, index: DataFrame) -> DataFrame:
    """(digest, winner, n, member): every group of the batch (shard, digest (distinct), winner, n) and the index together.

    A digest of the batch is a member if the slot that the hash names holds the very same 32 bytes: both groups become one, and the
    greater of their winners stays. Other digests are groups of their own. Slots that nothing came to return as they are.
    """
    winner = batch.schema["winner"].dataType
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("own", winner), T.StructField("past", winner), T.StructField("n", T.LongType()), T.StructField("member", T.BooleanType())])

    def probe(rows: pa.Table, shard: pa.Table) -> pa.Table:
        digest, own, n = (rows.column(c).combine_chunks() for c in ("digest", "winner", "n"))
        member, size = np.zeros(len(digest), bool), np.array(n)
        if not shard.num_rows:
            return pa.table([digest, own, pa.nulls(len(digest), own.type), size, member], names=schema.names)
        sizes, slots = shard.column("sizes")[0].as_py(), shard.column("slots").combine_chunks().flatten()
        held, known, words = _words(slots.field("digest")), np.array(slots.field("n")), _words(digest)
        bits = np.unpackbits(np.frombuffer(shard.column("bits")[0].as_py(), np.uint8), count=sum(sizes)).astype(bool)
        slot = slots_of(words, sizes, bits)
        member = slot >= 0
        member[member] = (held[slot[member]] == words[member]).all(axis=1)
        size[member] += known[slot[member]]
        rest = np.setdiff1d(np.arange(len(held)), slot[member])  # slots that nothing came to
        alone = np.zeros(len(rest), bool)
        return pa.table(
            [
                pa.concat_arrays([digest, slots.field("digest").take(pa.array(rest))]),
                pa.concat_arrays([own, pa.nulls(len(rest), own.type)]),
                slots.field("winner").take(pa.array(np.append(slot, rest), mask=np.append(~member, alone))),
                np.append(size, known[rest]),
                np.append(member, alone),
            ],
            names=schema.names,
        )

    found = batch.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(probe, schema)
    return found.select("digest", F.greatest("own", "past").alias("winner"), "n", "member")


def exact_dedup(docs: DataFrame, past: Column | None = None, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, shard_digests: int = 4096) -> DataFrame:
    """Groups of rows whose texts are identical after lower-casing A-Z; of each group one row stays, that with the largest id.

    ``past`` marks the rows that came before: the index is built over their distinct digests, and the digests of the other rows are looked up
    in it (default: rows with an even crc32 of their id are the past). It decides who is indexed and who is looked up, never the result.

    A null text counts as empty. An id that repeats is as good as another: of equal texts with the same largest id exactly one row
    stays. A null id is less than any other. Returns ``carried`` (a struct of the columns named in ``carry``, if any), id, keep_id (the
    id of the row that stays), group_size, kept, digest (SHA-256 of the normalised text, binary). Texts with one SHA-256 count as identical.

    Rows of equal digest are counted before they are shuffled, so a digest of a third of all rows reaches the next stage once a task. Shards hold
    about ``shard_digests`` distinct digests each, of the past or of the batch, whichever is more. Rows meet their group's result in a join, whose hot keys AQE splits.
    """
    if shard_digests < 1:
        raise ValueError("shard_digests must be positive")
    scratch = Scratch(docs.sparkSession)
    before = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0 if past is None else past
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _UPPER, _LOWER)
    carried = [F.struct(*[f"`{c}`" for c in carry]).alias("carried")] if carry else []
    rows = docs.select(*carried, F.col(id_col).alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.coalesce(before, F.lit(False)).alias("past"), F.monotonically_increasing_id().alias("place"))
    rows = scratch.put(rows, "rows")  # a row's place is its locator, so it must not change
    sums = scratch.put(rows.groupBy("digest", "past").agg(F.max(F.struct("id", "place")).alias("winner"), F.count(F.lit(1)).alias("n")), "sums")
    most = max([r["count"] for r in sums.groupBy("past").count().collect()], default=1)
    shard = F.pmod(F.xxhash64("digest"), F.lit(-(-most // shard_digests))).alias("shard")
    index = scratch.put(digest_index(sums.filter("past").select(shard, "digest", "winner", "n")), "index")
    groups = scratch.put(looked_up(sums.filter("not past").select(shard, "digest", "winner", "n"), index).drop("member"), "groups")
    scratch.drop("sums", "index")
    joined = rows.join(groups, "digest")
    lead = ["carried", "id"] if carry else ["id"]
    return joined.select(*lead, F.col("winner.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("place") == F.col("winner.place")).alias("kept"), "digest")
