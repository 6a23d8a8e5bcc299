"""Text quality: hashed word n-grams, logistic regression by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgraph.llm._text import buffer_of, mix, pieces, word_hashes

#: Kinds of bytes: 0 between words, 1 letters (and bytes from 0x80 on), 2 digits, 3 punctuation. A word is a run of one kind.
_KIND = np.full(256, 3, np.uint8)
_KIND[[*range(0x00, 0x21), 0x7F]] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[range(0x30, 0x3A)] = 2
_REPEAT, _REPEAT_LATER = mix(np.array([1, 2], np.uint64))


@dataclass(frozen=True)
class Model:
    """Weights by hashed n-gram, and the bias. ``gain`` scales the mean weight of a text's n-grams."""

    weights: np.ndarray
    bias: float
    gain: float


def _ngrams(buf: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed unigrams and bigrams of all texts, and the text of each."""
    kind = _KIND[buf]
    new = np.ones(len(buf), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offsets[offsets < len(buf)]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(buf))
    real = kind[starts] > 0 if len(starts) else np.empty(0, bool)
    starts, ends = starts[real], ends[real]
    owner = np.searchsorted(offsets, starts, "right") - 1
    one = word_hashes(buf, starts, ends)
    # a word that follows itself, at once or after one other, hashes as a repeat whatever the word is
    two = np.where(one[:-1] == one[1:], _REPEAT, mix(one[:-1] * np.uint64(0x2545F4914F6CDD1D) + one[1:]))[owner[:-1] == owner[1:]]
    again = owner[:-2][(owner[:-2] == owner[2:]) & (one[:-2] == one[2:]) & (one[:-2] != one[1:-1])]
    two_owner = owner[:-1][owner[:-1] == owner[1:]]
    shift = np.uint64(64 - bits)
    slots = np.concatenate((one, two, np.full(len(again), _REPEAT_LATER))) >> shift
    return slots.astype(np.int64), np.concatenate((owner, two_owner, again))


def score(model: Model, texts: pa.Array) -> np.ndarray:
    """The chance that each text is good: sparse dot products, all texts at once."""
    buf, offsets = buffer_of(texts)
    slots, owner = _ngrams(buf, offsets, int(len(model.weights)).bit_length() - 1)
    n = len(offsets) - 1
    total = np.bincount(owner, weights=model.weights[slots], minlength=n)
    count = np.maximum(np.bincount(owner, minlength=n), 1)
    return 1.0 / (1.0 + np.exp(-np.clip(model.bias + model.gain * total / count, -30, 30)))


def fit(texts: list[str | None], labels: list[int], *, bits: int = 18, gain: float = 24.0, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.002, l2: float = 0.05, epochs: int = 4) -> Model:
    """Logistic regression over a list of labelled texts, one update for each text and epoch, in the order given."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rows = []
    for at in range(0, len(texts), 256):
        buf, offsets = buffer_of(pa.array(texts[at : at + 256], pa.string()))
        slots, owner = _ngrams(buf, offsets, bits)
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(1, len(offsets) - 1))
        for own in np.split(slots[order], cuts):
            where, count = np.unique(own, return_counts=True)
            rows.append((np.append(where, size), np.append(gain * count / max(1, len(own)), 1.0)))

    def weights(where):
        zi = z[where]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[where])) / alpha + l2)
        return np.where(np.abs(zi) > l1, w, 0.0)

    for _ in range(epochs):
        for (where, x), y in zip(rows, labels, strict=True):
            w = weights(where)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            grown = n[where] + g * g
            z[where] += g - (np.sqrt(grown) - np.sqrt(n[where])) / alpha * w
            n[where] = grown
    w = weights(np.arange(size + 1))
    return Model(w[:size].astype(np.float32), float(w[size]), gain)


def held_out(id_col: str = "doc_id"):
    """The rows that labels are never learned from: crc32 of the id as text, modulo 3, is 1 (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sample(docs: DataFrame, labels: DataFrame, *, max_rows: int, max_chars: int) -> list[tuple[str, int]]:
    """(text, label) of labelled rows that aren't held out: whole texts in the order of their ids' hashes, as many of at most ``max_rows`` as hold no more than ``max_chars`` characters together (one at least)."""
    chosen = labels.select(F.col("doc_id").alias("id"), (F.col("quality") > 0).cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("id").isNotNull()).filter(~held_out("id"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # rows are chosen by their lengths alone; texts are read again for the chosen rows only
    lengths = docs.select(F.col("doc_id").alias("id"), F.length(text).alias("n"), F.xxhash64(text).alias("x")).join(chosen, "id")
    order = [F.xxhash64("id"), F.col("id"), F.col("x"), F.col("y")]
    some = lengths.orderBy(*order).limit(max_rows)
    used = F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # at most max_rows rows
    rows = some.select("id", "x", "y", F.row_number().over(Window.orderBy(*order)).alias("r"), used.alias("used")).filter((F.col("used") <= max_chars) | (F.col("r") == 1)).collect()  # at most max_rows rows of numbers
    # each different row is fetched once, however often it was chosen
    wanted = docs.sparkSession.createDataFrame(list({(r.id, r.x) for r in rows}), T.StructType([docs.select(F.col("doc_id").alias("id")).schema["id"], T.StructField("x", T.LongType())]))
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("x"), text.alias("t")).join(F.broadcast(wanted), ["id", "x"]).dropDuplicates(["id", "x"])
    text_of = {(r.id, r.x): r.t for r in texts.collect()}
    return [(text_of[r.id, r.x], r.y) for r in sorted(rows, key=lambda r: r.r)]


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = 6000, max_chars: int = 40_000_000) -> Model:
    """A model from labelled texts that aren't held out.

    The sample: of the labelled ids that ``docs`` has, those with the smallest hashes, each with its whole text; ``max_rows`` and
    ``max_chars`` bound it, and what the driver holds, whatever the input's size. Null labels are ignored; labels above 0
    count as 1. With no labelled text every score is 0.5.
    """
    rows = sample(docs, labels, max_rows=max_rows, max_chars=max_chars)
    return fit([t for t, _ in rows], [y for _, y in rows])


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score) for each row: ``row`` a struct of all its columns, whatever their names, and 0 to 1 from the whole text alone (null: as an empty text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.append_column("text", batch.column(0).field(place))
            for part in pieces(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score(shared.value, part.column(1)), pa.float64())], names=["row", "score"])

    place = docs.columns.index("text")
    rows = docs.select(F.struct(*[F.col("text").cast("string").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
