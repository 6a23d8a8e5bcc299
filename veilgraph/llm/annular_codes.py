"""Vector code compression: integer product codebooks, whose nearest entries are searched within an annulus of norms.

An entry at distance d or less from a vector has a norm within d of the vector's norm. So entries are sorted by norm; the
distance found so far allows an interval of norms, binary searches give its ends, and only the entries between them (both ends
included) are evaluated, exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgraph.store import Scratch

#: A component becomes floor(SCALE * x).
SCALE = 1024
#: An integer component beyond this counts as this.
LARGEST = 10**17
#: Rows of neighbouring norms that are searched together, and entries next to a row's norm that give its first distance.
_BLOCK, _NEAR = 512, 16
#: Labels that are sent to every task at most.
_MOST_SENT = 100_000


def integers(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(places of the vectors that are kept, their lengths, their integer components)."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(vectors.flatten(), pa.float64()).to_numpy(zero_copy_only=False)  # null: nan
    ends = np.cumsum(lengths)
    bad = np.append(0, np.cumsum(~np.isfinite(flat)))
    kept = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - lengths]))
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST)
    return kept, lengths[kept], [whole[ends[i] - lengths[i] : ends[i]] for i in kept]


def _exact(values: np.ndarray) -> bool:
    """Whether squared distances among such values are exact in double precision."""
    return not values.size or 4 * values.shape[-1] * int(np.abs(values).max()) ** 2 < 2**53


def _python(values: np.ndarray) -> np.ndarray:
    """The same numbers as Python integers, which don't overflow."""
    return np.array([[int(v) for v in row] for row in values], object).reshape(values.shape)


@dataclass(frozen=True)
class Book:
    """The entries of one part, sorted by norm."""

    entries: np.ndarray
    squares: np.ndarray
    norms: np.ndarray
    number: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray) -> Book:
        squares = (entries * entries).sum(axis=1)
        norms = np.sqrt(squares.astype(np.float64))
        order = np.argsort(norms, kind="stable")
        return cls(entries[order], squares[order], norms[order], order)


def _distances(rows: np.ndarray, square: np.ndarray, book: Book, a: int, b: int) -> np.ndarray:
    return square[:, None] - 2 * (rows @ book.entries[a:b].T) + book.squares[a:b]


def nearest(rows: np.ndarray, book: Book) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest entry; ties go to the lower number."""
    number, least = np.empty(len(rows), np.int64), np.empty(len(rows), rows.dtype)
    square = (rows * rows).sum(axis=1)
    norm = np.sqrt(square.astype(np.float64))
    order = np.argsort(norm, kind="stable")
    k = len(book.norms)
    for at in range(0, len(rows), _BLOCK):
        own = order[at : at + _BLOCK]
        x, sq, r = rows[own], square[own], norm[own]
        a = max(0, int(np.searchsorted(book.norms, r[0])) - _NEAR // 2)
        b = min(k, int(np.searchsorted(book.norms, r[-1])) + _NEAR // 2)
        a = min(a, k - 1)
        reach = np.sqrt(_distances(x, sq, book, a, max(b, a + 1)).min(axis=1).astype(np.float64))
        slack = 1e-9 * (r + reach + 1)  # roots are rounded: the ends stay inside
        low = np.searchsorted(book.norms, r - reach - slack, "left")
        high = np.searchsorted(book.norms, r + reach + slack, "right")
        a, b = int(low.min()), int(high.max())
        found = _distances(x, sq, book, a, b)
        place = np.arange(a, b)
        outside = (place < low[:, None]) | (place >= high[:, None])
        best = np.where(outside, found.max(), found).min(axis=1)
        least[own] = best
        number[own] = np.where(outside | (found != best[:, None]), k, book.number[a:b]).min(axis=1)
    return number, least


@dataclass(frozen=True)
class Codebooks:
    """Integer entries by part, entry and position; empty if no vector could be cut."""

    parts: int
    entries: np.ndarray

    @property
    def length(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str | None:
        text = ",".join(str(int(v)) for v in self.entries.ravel())
        return hashlib.sha256(text.encode()).hexdigest() if self.entries.size else None


def _assigned(values: list[np.ndarray], books: Codebooks) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, number, squared distance) for each part of vectors of the books' length."""
    rows = np.stack(values).reshape(len(values), books.parts, -1)
    entries = books.entries
    if not (_exact(rows) and _exact(entries.astype(np.float64))):
        rows, entries = _python(rows.reshape(len(values), -1)).reshape(rows.shape), entries.astype(object)
    else:
        entries = entries.astype(np.float64)
    return [(rows[:, p], *nearest(rows[:, p], Book.of(entries[p]))) for p in range(books.parts)]


def _first_entries(vectors: DataFrame, parts: int, entries: int, scratch: Scratch) -> Codebooks:
    """The parts of the vectors of the smallest ids. A batch offers its smallest of every length; so one pass tells the length too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, length, values = integers(batch.column(1))
            order = pc.sort_indices(batch.column(0).take(pa.array(kept))).to_numpy()
            taken: dict[int, int] = {}
            mine = []
            for i in order:
                n = int(length[i])
                taken[n] = taken.get(n, 0) + 1
                if n and n % parts == 0 and taken[n] <= entries:
                    mine.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept[mine], pa.int64())), pa.array(length[mine], pa.int64()), pa.array([values[i].astype(np.int64) for i in mine], pa.list_(pa.int64()))], names=["id", "length", "whole"])

    schema = T.StructType([T.StructField("id", vectors.schema[0].dataType), T.StructField("length", T.LongType()), T.StructField("whole", T.ArrayType(T.LongType()))])
    offered = scratch.put(vectors.mapInArrow(run, schema), "offered")
    order = [F.col("id").asc_nulls_last(), F.col("whole")]
    first = offered.orderBy(*order).select("length").first()
    if first is None:
        return Codebooks(parts, np.zeros((parts, 0, 0), np.int64))
    chosen = offered.filter(F.col("length") == first["length"]).orderBy(*order).limit(entries).select("whole").collect()
    scratch.drop("offered")
    whole = np.array([r["whole"] for r in chosen], np.int64).reshape(len(chosen), parts, -1)
    return Codebooks(parts, np.ascontiguousarray(whole.transpose(1, 0, 2)))


def _sums(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(part, entry, n, s): how many parts each entry got, and their sums by position; a task sends at most a row for each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(books.entries.shape, object)
        count = np.zeros(books.entries.shape[:2], np.int64)
        for batch in batches:
            _, length, values = integers(batch.column(1))
            values = [v for v, n in zip(values, length, strict=True) if n == books.length]
            if not values:
                continue
            for p, (rows, number, _) in enumerate(_assigned(values, books)):
                count[p] += np.bincount(number, minlength=count.shape[1])
                order = np.argsort(number, kind="stable")
                first = np.flatnonzero(np.append(True, number[order][1:] != number[order][:-1]))
                total[p, number[order][first]] += np.array([[int(v) for v in row] for row in np.add.reduceat(rows[order], first)], object).reshape(len(first), -1)
        part, entry = np.nonzero(count)
        sums = [[Decimal(v) for v in total[p, e]] for p, e in zip(part, entry, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), pa.array(sums, pa.list_(pa.decimal128(38, 0)))], names=["part", "entry", "n", "s"])

    return vectors.mapInArrow(run, "part long, entry long, n long, s array<decimal(38,0)>")


def train(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4) -> Codebooks:
    """Integer codebooks, one for each of ``parts`` equal parts of the vectors.

    Components are floor(1024 x). Each book starts as that part of the ``entries`` smallest ids (null ids last, equal ids by vector). A round
    gives every part to its nearest entry (squared distance, ties to the lower number), then replaces each entry by the
    floor of its parts' mean; entries without parts stay. Vectors that are null or hold null or non-finite components take no part,
    nor do those of another length than the first of these vectors whose length the parts divide.

    A round is one pass over the vectors; a task sends a row for each entry at most, and the driver gets the books alone.
    """
    scratch = Scratch(vectors.sparkSession)
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    books = _first_entries(own, parts, entries, scratch)
    if not books.entries.size:
        return books
    size = books.entries.shape[2]
    for _ in range(rounds):
        totals = _sums(own, books).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(size)])
        new = books.entries.copy()
        for r in totals.collect():  # parts * entries rows at most
            new[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(size)]
        books = Codebooks(parts, new)
    return books


def encode(vectors: DataFrame, books: Codebooks, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = None) -> DataFrame:
    """id, label (if its column is named), code (two hex digits a part) and error (squared distances summed over parts).

    Vectors that are null or hold null or non-finite components are dropped. Code and error are null where a vector hasn't the books' length, and
    error is null beyond a BIGINT.
    """
    label = [F.col(label_col).alias("label")] if label_col else []
    own = vectors.select(F.col(id_col).alias("id"), *label, F.col(vector_col).alias("v"))
    lead = own.drop("v")
    names = lead.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, length, values = integers(batch.column(len(names)))
            code: list[str | None] = [None] * len(kept)
            error: list[int | None] = [None] * len(kept)
            fits = np.flatnonzero(length == books.length) if books.entries.size else []
            if len(fits):
                found = _assigned([values[i] for i in fits], books)
                digits = np.stack([number for _, number, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                total = sum(distance for _, _, distance in found)
                for j, i in enumerate(fits):
                    code[i] = digits[2 * books.parts * j : 2 * books.parts * (j + 1)]
                    error[i] = int(total[j]) if total[j] < 2**63 else None
            places = pa.array(kept)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(places) for i in range(len(names))), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=[*names, "code", "error"])

    return own.mapInArrow(run, lead.schema.add("code", "string").add("error", "long"))


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """id, label, code, error, label_error (error summed over equal labels, nulls together) and codebooks_sha256 for every vector that is kept.

    ``entries`` is 256 at most, so that two hex digits hold a number. ``codebooks_sha256`` is the hash of all final entries'
    components in decimal, by part, entry and position, joined by commas; null if no vector could be cut in parts.
    Labels' sums are broadcast only after they were counted; otherwise they are joined by label, where AQE splits a frequent one.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    scratch = Scratch(vectors.sparkSession)
    books = train(vectors, id_col=id_col, vector_col=vector_col, parts=parts, entries=entries, rounds=rounds)
    coded = scratch.put(encode(vectors, books, id_col=id_col, vector_col=vector_col, label_col=label_col), "coded")
    totals = scratch.put(coded.groupBy(F.col("label").alias("l")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")), "totals")
    sent = F.broadcast(totals) if totals.count() <= _MOST_SENT else totals
    return coded.join(sent, F.col("label").eqNullSafe(F.col("l"))).select("id", "label", "code", "error", "label_error", F.lit(books.sha256()).cast("string").alias("codebooks_sha256"))
