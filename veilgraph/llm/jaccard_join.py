"""N-gram Jaccard join: MinHash bands find candidates, full shingle sets verify them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.llm._repeats import at_most, identity, repeated_rows
from veilgraph.store import Scratch
from veilgraph.llm._text import PIECE_BYTES, buffer_of, byte_table, mix, pieces, word_hashes, word_spans

_RNG = np.random.Generator(np.random.Philox(1337))
_MULTIPLIERS = _RNG.integers(1, 2**64, 1024, dtype=np.uint64) | np.uint64(1)
_ADDENDS = _RNG.integers(0, 2**64, 1024, dtype=np.uint64)
#: Words: runs of digits, letters and bytes from 0x80 on, A-Z lower-cased.
_IN_WORD = byte_table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_COLUMNS = 4096


def bands_for(threshold: float, recall: float, hashes: int = 128) -> tuple[int, int]:
    """The most rows a band whose bands, within so many hashes, still find a pair at the threshold with this probability.

    >>> bands_for(0.8, 0.999)
    (25, 5)
    """
    for rows in range(16, 0, -1):
        bands = hashes // rows
        if bands and 1 - (1 - threshold**rows) ** bands >= recall:
            return bands, rows
    return hashes, 1


def shingles_of(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words, and each text's first. A text of fewer words, but not none, has one: all its words."""
    buf, offsets = buffer_of(texts)
    buf = _LOWER[buf]
    starts, ends, firsts = word_spans(buf, offsets, _IN_WORD)
    words = word_hashes(buf, starts, ends)
    counts = np.diff(firsts)
    padded = np.append(words, np.zeros(size, np.uint64))
    total = np.zeros(len(words), np.uint64)
    left = np.repeat(firsts[1:], counts) - np.arange(len(words))  # words from here to the text's end
    for i in range(size):
        total += np.where(left > i, padded[i : i + len(words)] * _MULTIPLIERS[i] + _ADDENDS[i], np.uint64(0))
    first_of = np.arange(len(words)) == np.repeat(firsts[:-1], counts)
    keep = (left >= size) | (first_of & (left < size))
    sums = np.concatenate(([0], np.cumsum(keep)))
    return mix(total[keep]), sums[firsts]


def _sets(bodies: list[bytes], size: int) -> list[np.ndarray]:
    """The shingle set of each packed text. Texts are unpacked a few at a time."""
    unpack, sets, held, total = zstandard.ZstdDecompressor(), [], [], 0
    for k, body in enumerate(bodies):
        held.append(unpack.decompress(body))
        total += len(held[-1])
        if total > PIECE_BYTES or k == len(bodies) - 1:
            values, firsts = shingles_of(pa.array(held, pa.binary()), size)
            sets += [np.unique(values[a:b]) for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
            held, total = [], 0
    return sets


def _signatures(texts: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(id, d, t, c, size, bands): c names the shingle set; null where a text has no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                values, firsts = shingles_of(part.column(3), size)
                some = np.flatnonzero(np.diff(firsts) > 0)
                keys = np.zeros((len(some), bands), np.uint64)
                if len(some):
                    begins = firsts[:-1][some]
                    for b in range(bands):
                        for r in range(rows):
                            k = b * rows + r
                            keys[:, b] += np.minimum.reduceat(values * _MULTIPLIERS[16 + k] + _ADDENDS[16 + k], begins) * _MULTIPLIERS[512 + r]
                    keys = mix(keys + np.arange(bands, dtype=np.uint64) * _MULTIPLIERS[600])
                names, sizes = [None] * part.num_rows, [0] * part.num_rows
                listed: list = [None] * part.num_rows
                for i, row in zip(some.tolist(), keys.view(np.int64), strict=True):
                    own = np.unique(values[firsts[i] : firsts[i + 1]])
                    names[i], sizes[i], listed[i] = xxhash.xxh3_128_digest(own.tobytes()), len(own), row
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(listed, pa.list_(pa.int64()))],
                    names=["id", "d", "t", "c", "size", "bands"],
                )

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, d long, t long, c binary, size long, bands array<long>")


def _dealt(texts: DataFrame, members: DataFrame) -> DataFrame:
    """Each member's text for each of its buckets; for a bucket of several blocks, for each pair of blocks that holds its block."""
    names = ["bucket", "low", "high", "own", "band", "c", "copies", "kept", "body"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary()]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in pieces(batch):
                for row in part.to_pylist():
                    body = pack.compress(row["text"].encode())
                    for band, (bucket, blocks) in enumerate(zip(row["kept"], row["blocks"], strict=True)):
                        own = int.from_bytes(row["c"][:6], "little") % blocks if blocks else 0
                        for other in range(blocks):
                            yield bucket, min(own, other), max(own, other), own, band, row["c"], row["copies"], row["kept"], body

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

        out: list[tuple] = []
        total = 0
        for place in places(batches):
            out.append(place)
            total += len(place[-1])
            if len(out) > 2000 or total > PIECE_BYTES:
                yield done()
                out, total = [], 0
        if out:
            yield done()

    joined = texts.join(members, ["d", "t"]).select("c", "copies", "kept", "blocks", "text")
    return joined.mapInArrow(run, "bucket long, low int, high int, own int, band int, c binary, copies long, kept array<long>, body binary")


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets share, from products of 0/1 columns; values of one set alone make no column."""
    n = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    column = np.cumsum(new) - 1
    many = np.bincount(column)[column] > 1
    owner, column = owner[many], column[many]
    out = np.zeros((n, n), np.float32)
    if not len(column):
        return out
    column = np.unique(column, return_inverse=True)[1]
    for at in range(0, int(column[-1]) + 1, _COLUMNS):
        a, b = np.searchsorted(column, [at, at + _COLUMNS])
        ones = np.zeros((n, _COLUMNS), np.float32)
        ones[owner[a:b], column[a:b] - at] = 1
        out += ones @ ones.T
    return out


def _group_links(rows: list[dict], size: int, threshold: float) -> list[tuple]:
    """(c, root, links) of the members with links that this group is the first to see."""
    n = len(rows)
    if n < 2:
        return []
    sets = _sets([r["body"] for r in rows], size)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    shared = _intersections(sets).astype(np.int64)
    # exactly |A and B| >= threshold * |A or B|, but for the last digits of the product
    near = np.triu(shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-9, 1)
    if rows[0]["low"] != rows[0]["high"]:
        own = np.array([r["own"] for r in rows])
        near &= own[:, None] != own[None, :]
    i, j = np.nonzero(near)
    if not len(i):
        return []
    kept = np.array([r["kept"] for r in rows], np.int64)
    band = rows[0]["band"]
    first = np.ones(len(i), bool)
    for b in range(band):
        first &= (kept[i, b] != kept[j, b]) | (kept[i, b] == 0)
    i, j = i[first], j[first]
    copies = np.array([r["copies"] for r in rows], np.float64)
    links = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(rows[k]["c"], rows[label[k]]["c"], int(links[k])) for k in np.flatnonzero(links)]


def _verified(dealt: DataFrame, size: int, threshold: float) -> DataFrame:
    key = ["bucket", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[dict]) -> pa.RecordBatch:
            found = _group_links(rows, size, threshold)
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate([pa.binary(), pa.binary(), pa.int64()])], names=["c", "root", "links"])

        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and any(held[0][k] != row[k] for k in key):
                    yield done(held)
                    held = []
                held.append(row)
        if held:
            yield done(held)

    return dealt.repartition(*key).sortWithinPartitions(*key, "c").mapInArrow(run, "c binary, root binary, links long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(c, label): the least node that each node of ``edges`` (c, root) reaches.

    Each round takes the least label among neighbours and then that label's own label, and writes its table, until
    no label moves; labels only fall, so the rounds end.
    """
    both = scratch.put(edges.select("c", "root").union(edges.select("root", "c")).distinct(), "edges")
    labels = scratch.put(both.groupBy("c").agg(F.min("root").alias("r")).select("c", F.least("c", "r").alias("label")), "labels0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.withColumnsRenamed({"c": "root", "label": "seen"}), "root").groupBy("c").agg(F.min("seen").alias("seen"))
        low = scratch.put(labels.join(near, "c").select("c", F.least("label", "seen").alias("label"), F.col("label").alias("was")), f"low{step}")
        jump = low.select(F.col("c").alias("label"), F.col("label").alias("next"))
        new = scratch.put(low.join(jump, "label").select("c", F.col("next").alias("label"), (F.col("next") != F.col("was")).alias("moved")), f"labels{step}")
        scratch.drop(f"labels{step - 1}", f"low{step}")
        labels = new.select("c", "label")
        if new.filter("moved").isEmpty():
            return labels


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, recall: float = 0.999, bucket_limit: int = 1024, bucket_shingles: int = 1 << 23) -> DataFrame:
    """Near-duplicate classes over sets of word ``size``-grams with a Jaccard similarity of at least ``threshold``.

    A row for each input row: id, class_id (the least id of all documents that links connect to it, itself included),
    n_links (other documents whose similarity reaches the threshold, equal sets included), n_shingles, and d, t and
    keeper (whether (d, t) names the class's least document; rows that agree in id and text all are). A text of fewer
    words than ``size`` has one shingle; one without words (or null) forms a class of its own with no links.

    Texts with equal shingle sets collapse into one class row before any join. Bands and rows are chosen for
    ``recall`` at the threshold; buckets with the same members are compared once. A pair counts in the first bucket that
    it shares. Buckets above ``bucket_limit`` texts, or whose sets sum to more than ``bucket_shingles``, are dealt out
    as pairs of blocks, each one task's work, and a task returns a row for each member with its number of links, never
    the pairs.
    """
    bands, rows = bands_for(threshold, recall)
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), *identity(docs, id_col, text_col), F.col(text_col).cast("string").alias("text"))
    signed = scratch.put(_signatures(texts, size, bands, rows), "signed")
    classes = scratch.put(
        signed.filter("c is not null").groupBy("c").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("d", "t")).alias("first"), F.first("size").alias("size"), F.first("bands").alias("bands")).select("c", "copies", "first.d", "first.t", "size", "bands"), "classes"
    )
    exploded = classes.select("c", "size", F.posexplode("bands").alias("band", "bucket"))
    sized = (
        exploded.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.bit_xor(F.xxhash64("c")).alias("x"), F.min("c").alias("least"), F.max("c").alias("most"))
        .filter("n > 1")
    )
    halves = F.least("n", F.ceil(F.greatest(F.col("n") / max(bucket_limit // 2, 1), F.col("total") / max(bucket_shingles // 2, 1))))
    blocks = F.when((F.col("n") <= bucket_limit) & (F.col("total") <= bucket_shingles), 1).otherwise(halves).cast("long")
    buckets = scratch.put(sized.groupBy("n", "total", "x", "least", "most").agg(F.min("bucket").alias("bucket")).select("bucket", blocks.alias("blocks")), "buckets")
    inside = exploded.join(buckets, "bucket").groupBy("c").agg(F.map_from_entries(F.collect_list(F.struct("band", F.struct("bucket", "blocks").alias("b")))).alias("own"))
    each = F.sequence(F.lit(0), F.lit(bands - 1))
    members = scratch.put(
        classes.join(inside, "c").select(
            "c", "copies", "d", "t",
            F.transform(each, lambda b: F.coalesce(F.col("own")[b]["bucket"], F.lit(0).cast("long"))).alias("kept"),
            F.transform(each, lambda b: F.coalesce(F.col("own")[b]["blocks"], F.lit(0).cast("long"))).alias("blocks"),
        ),
        "members",
    )
    scratch.drop("buckets")
    once = at_most(1, texts.select("d", "t", "text"), scratch.put(repeated_rows(signed), "again"))
    links = scratch.put(_verified(_dealt(once, members), size, threshold), "links")
    scratch.drop("members", "again")
    labels = components(links.filter("c != root"), scratch)
    counted = links.groupBy("c").agg(F.sum("links").alias("links"))
    found = scratch.put(classes.select("c", "copies").join(labels, "c", "left").join(counted, "c", "left").select("c", F.coalesce("label", "c").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "found")
    rows_ = scratch.put(signed.select("id", "d", "t", "c", "size").join(found, "c", "left"), "rows")
    heads = scratch.put(rows_.filter("label is not null").groupBy("label").agg(F.min("id").alias("class_id"), F.min(F.struct("d", "t")).alias("head")), "heads")
    out = rows_.join(heads, "label", "left")
    alone = F.col("label").isNull()
    scratch.drop("classes", "links", "edges", "found", "signed")
    return out.select(
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("size").alias("n_shingles"),
        "d",
        "t",
        (alone | (F.col("head") == F.struct("d", "t"))).alias("keeper"),
    )


def expected_recall(similarity: float, bands: int, rows: int) -> float:
    """The chance that a pair of this similarity shares a band."""
    return 1 - math.pow(1 - similarity**rows, bands)
