"""Approximate functional dependencies of every right side, from stripped partitions of growing column sets.

A column set parts the rows into classes of equal values; a stripped partition leaves out classes of one row, which can't err. Columns are put in
order, those of most values first, and a set belongs to the first of its columns: rows are dealt once for each column by its values, with that
column and those after it, so all classes of its sets lie in one task each and are counted there, ever larger sets from the rows that
are not yet alone. Rows are moved once for each column, however many sets there are. The last columns, whose values have few
combinations, are counted by these.

With n rows in classes of several, c such classes, and in each the largest class t of the set with the right side added, the rows to
delete so that the set determines the right side are n - c - sum(t - 1). Where the right side is the column that the rows were dealt by, t is the
largest over tasks, and only the largest of each task is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.store import Scratch

#: Rows of a task, combinations of values that are sent to one task, and rows of one value from which on they are dealt by more columns.
_BLOCK, _MOST_SENT, _MOST_ALIKE = 200_000, 1_000_000, 2_000_000
_FOUND = "s long, r int, p1 long, p2 long, v long, c long"


def _members(s: int) -> list[int]:
    return [i for i in range(s.bit_length()) if s >> i & 1]


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows' order by their keys, where runs of equal keys begin in it, and for each place the number of its run."""
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _codes(*keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal numbers from 0 for rows of equal keys, and how many there are."""
    order, begin, run = _runs(*keys)
    code = np.empty(len(order), np.int64)
    code[order] = run
    return code, len(begin)


def _classes(hashes: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, bits: list[int], lead: int, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """What all sets of at most ``most`` columns that hold the first ``lead`` ones give, among rows that hold whole classes of these."""
    coded = [_codes(*h) for h in hashes]
    none = np.zeros(1, np.int64)

    def parent(own: list[int], rows: np.ndarray) -> np.ndarray:
        key, size = np.zeros(len(rows), np.int64), 1
        for i in own:
            if size * coded[i][1] >= 1 << 62:
                key, size = _codes(key)
            key, size = key * coded[i][1] + coded[i][0][rows], size * coded[i][1]
        return key

    def visit(own: list[int], rows: np.ndarray, key: np.ndarray) -> Iterator[tuple]:
        """``rows``: those not alone in the set without its last column; ``key``: their class in the set."""
        order, begin, run = _runs(key)
        n = np.add.reduceat(weight[rows[order]], begin)
        several = n > 1
        if not several.any():
            return
        s, first, n = sum(1 << bits[i] for i in own), rows[order][begin][several], n[several]
        yield s, -1, none, none, np.array([n.sum()]), len(n)
        for i in own if len(own) > 1 else []:
            rest = [j for j in own if j != i]
            if i >= lead:
                where, starts, _ = _runs(parent(rest, first))
                yield s & ~(1 << bits[i]), bits[i], none, none, np.array([(np.maximum.reduceat(n[where], starts) - 1).sum()]), -1
            else:
                p = [np.bitwise_xor.reduce([hashes[j][half][first] for j in rest]) for half in (0, 1)]
                where, starts, _ = _runs(*p)
                yield s & ~(1 << bits[i]), bits[i], p[0][where][starts], p[1][where][starts], np.maximum.reduceat(n[where], starts), -2
        if len(own) < most:
            stay = several[run]
            rows, (key, _) = rows[order][stay], _codes(run[stay])
            for i in range(max(own[-1] + 1, lead), len(bits)):
                yield from visit([*own, i], rows, key * coded[i][1] + coded[i][0][rows])

    every = np.arange(len(weight))
    if lead:
        yield from visit(list(range(lead)), every, parent(list(range(lead)), every))
    else:
        for i in range(len(bits)):
            yield from visit([i], every, coded[i][0])


def discover_all(rows: DataFrame, columns: list[str], most: int = 3, threshold: float = 0.05) -> DataFrame:
    """g3 of every set of at most ``most`` columns towards every other column: (lhs, rhs, n, errors, g3, weight, valid).

    Nulls equal each other; no rows give no error. Values are told apart by 128 bits of hashes.
    """
    columns = sorted(columns)
    if len(columns) < 2 or len(columns) > 62 or most < 1:
        raise ValueError("there must be 2 to 62 columns, and sets of at least one")
    spark, m = rows.sparkSession, len(columns)
    scratch, largest = Scratch(spark), min(most + 1, m)
    cast = lambda c: F.col(f"`{c}`") + F.lit(0.0) if dict(rows.dtypes)[c] in ("double", "float") else F.col(f"`{c}`")  # noqa: E731  zeros have no sign
    base = rows.select(*[cast(c).alias(f"c{i}") for i, c in enumerate(columns)])
    hashed = lambda i, half: F.xxhash64(F.lit(2 * i + half), f"c{i}", F.isnull(f"c{i}"))
    counts = base.agg(F.count(F.lit(1)), *[F.approx_count_distinct(f"c{i}") for i in range(m)]).first()
    total, values = counts[0], [v + 1 for v in counts[1:]]
    order = sorted(range(m), key=lambda i: -values[i])
    parts = max(2 * spark.sparkContext.defaultParallelism, 1 + total // _BLOCK)
    few = m
    while few and np.prod([float(values[i]) for i in order[few - 1 :]]) <= _MOST_SENT:
        few -= 1
    # where the rows are dealt by is chosen from some of them; all of them are counted
    some = base.sample(min(1.0, 50_000 / max(total, 1)), seed=7).select(*[hashed(i, 0).alias(f"c{i}") for i in range(m)]).toArrow()

    def alike(own: list[int]) -> float:
        """About how many rows share a value of these columns at most."""
        if total <= _MOST_ALIKE or not some.num_rows:
            return 0
        return total * np.bincount(_codes(*[some.column(f"c{i}").to_numpy() for i in own])[0]).max() / some.num_rows

    stats: dict[int, tuple[int, int]] = {}
    best: dict[tuple[int, int], int] = {}

    def count(source: DataFrame, own: list[int], lead: int, size: int) -> None:
        hashes = source.select(*[hashed(i, half).alias(f"h{half}_{i}") for i in own for half in (0, 1)], "n")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if held:
                h = [np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(2 * len(own) + 1)]
                held.clear()
                for s, r, p1, p2, v, c in _classes(list(zip(h[:-1:2], h[1:-1:2], strict=True)), h[-1], own, lead, size):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), s)), pa.array(np.full(len(v), r, np.int32)), pa.array(p1), pa.array(p2), pa.array(v), pa.array(np.full(len(v), c))], names=["s", "r", "p1", "p2", "v", "c"])

        found = scratch.put(hashes.mapInArrow(run, _FOUND), "found")
        for r in found.filter("c != -2").groupBy("s", "r").agg(F.sum("v").alias("v"), F.sum("c").alias("c")).collect():  # a row for each set and right side
            if r.r < 0:
                stats[r.s] = r.v, r.c
            else:
                best[r.s, r.r] = r.v
        for r in found.filter("c = -2").groupBy("s", "r", "p1", "p2").agg(F.max("v").alias("v")).groupBy("s", "r").agg(F.sum(F.col("v") - 1).alias("v")).collect():
            best[r.s, r.r] = r.v
        scratch.drop("found")

    def deal(lead: list[int], rest: list[int]) -> None:
        """Counts all sets of ``lead`` and any of ``rest``; a value that too many rows share is dealt on by the next columns."""
        names = [f"c{i}" for i in (*lead, *rest)]
        if len(lead) == largest or alike(lead) > _MOST_ALIKE:
            own = [f"c{i}" for i in lead]
            count(base.groupBy(*own).agg(F.count(F.lit(1)).alias("n")), lead, len(lead), len(lead))
            for k, i in enumerate(rest if len(lead) < largest else []):
                deal([*lead, i], rest[k + 1 :])
        else:
            count(base.select(*names, F.lit(1).cast("long").alias("n")).repartition(parts, *names[: len(lead)]), [*lead, *rest], len(lead), largest)

    if few < m:
        combined = base.groupBy(*[f"c{i}" for i in order[few:]]).agg(F.count(F.lit(1)).alias("n"))
        count(combined.repartition(1), order[few:], 0, largest)  # _MOST_SENT rows at most
    for k in range(few):
        deal([order[k]], order[k + 1 :])
    out = []
    for k in range(1, min(most, m - 1) + 1):
        for c in combinations(range(m), k):
            s = sum(1 << i for i in c)
            n, classes = stats.get(s, (0, 0))
            for right in range(m):
                if right not in c:
                    out.append((",".join(columns[i] for i in c), columns[right], total, n - classes - best.get((s, right), 0)))
    found = spark.createDataFrame(out, "lhs string, rhs string, n long, errors long")
    g3 = F.coalesce(F.try_divide(F.col("errors").cast("double"), F.col("n")), F.lit(0.0))
    return found.select("lhs", "rhs", "n", "errors", g3.alias("g3"), (1 - g3).alias("weight"), (g3 <= threshold).alias("valid"))
