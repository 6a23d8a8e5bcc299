"""How many pairs of rows violate a constraint, without making the pairs.

A predicate ``!=`` is all pairs less those that are equal, so a constraint becomes a signed sum of terms of equalities and
order predicates alone. Equalities are a group. A term without an order predicate is a product of group sizes; one with one or
two counts, for each left row (a query), the right rows (points) of its group that come before it in both orders.

Queries and points are sorted into ranges by (group, first attribute, second attribute). Points of a query's own range are counted in a
tree over the second attribute. Of a group that lies in several ranges, points in lower ranges come before its queries in the first order whatever
their place there, so they are counted by the second: sorted into ranges by (group, second attribute), with a tree over the numbers of
the first ranges; and points lower in both ranges are counted by cells (range, range), of which there are as many as
ranges squared. Rows that agree in all that a term looks at move as one, with their number.

With a third order predicate the rows are sorted into ranges three times, by the third attribute, the first and the second. Each pass counts
the pairs that share its range but lie in order in the ranges of the passes before, and what is left is in order in all three ranges, of which there
are at most ``_MOST_RANGES``: so the rows are moved three times, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgraph.functions.expressions import holds
from veilgraph.operators.pairs import Predicate
from veilgraph.store import Scratch

_EQUAL, _UNEQUAL = ("==", "=", "EQUAL"), ("!=", "<>", "UNEQUAL")
#: For each order predicate: whether right values must be greater, and whether equal ones count.
_ORDERS = {
    "<": (True, False), "LESS": (True, False), "<=": (True, True), "LESS_EQUAL": (True, True), "LESS_OR_EQUAL": (True, True),
    ">": (False, False), "GREATER": (False, False), ">=": (False, True), "GREATER_EQUAL": (False, True), "GREATER_OR_EQUAL": (False, True),
}
#: Rows of a range and ranges at most, where three order predicates are counted; rows whose pairs are compared one by one.
_RANGE, _MOST_RANGES, _SQUARE = 200_000, 96, 128
_TURNED = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "LESS": ">", "GREATER": "<", "LESS_EQUAL": ">=", "LESS_OR_EQUAL": ">=", "GREATER_EQUAL": "<=", "GREATER_OR_EQUAL": "<="}


class Tree:
    """Sums of the weights of points at places a to b whose number is below a bound, for many questions at once.

    One level for each bit of the numbers, of which ``size`` is a bound: a level puts the points with that bit 0 before those with 1, in their
    former order, so a stretch of places is a stretch again on either side.
    """

    def __init__(self, number: np.ndarray, weight: np.ndarray, size: int):
        self.bits = int(size).bit_length()
        self.levels = []
        for bit in range(self.bits - 1, -1, -1):
            zero = (number >> bit) & 1 == 0
            self.levels.append((np.append(0, np.cumsum(zero)), np.append(0, np.cumsum(np.where(zero, weight, 0)))))
            order = np.concatenate((np.flatnonzero(zero), np.flatnonzero(~zero)))
            number, weight = number[order], weight[order]

    def below(self, a: np.ndarray, b: np.ndarray, bound: np.ndarray) -> np.ndarray:
        total = np.zeros(len(a), np.int64)
        for k, (zeros, weights) in enumerate(self.levels):
            one = (bound >> (self.bits - 1 - k)) & 1 == 1
            total += np.where(one, weights[b] - weights[a], 0)
            a, b = np.where(one, zeros[-1] + a - zeros[a], zeros[a]), np.where(one, zeros[-1] + b - zeros[b], zeros[b])
        return total


def _starts(group: np.ndarray) -> np.ndarray:
    """For each row of a sorted array the place of the first row of its group."""
    new = np.append(True, group[1:] != group[:-1])
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def _paired(times: np.ndarray, found: np.ndarray) -> int:
    """The sum of products, as a Python integer."""
    if len(times) and int(times.sum()) * int(found.max()) < 1 << 62:
        return int(times @ found)
    return sum(int(t) * int(f) for t, f in zip(times.tolist(), found.tolist(), strict=True))


def _before(group: np.ndarray, number: np.ndarray, bound: np.ndarray, query: np.ndarray, times: np.ndarray) -> int:
    """Pairs of a query and a point before it in the rows' order, of its group, whose number is below the query's bound."""
    at = np.flatnonzero(query)
    if not len(at) or len(at) == len(query):
        return 0
    tree = Tree(number[~query], times[~query], int(max(number.max(), bound.max())) + 1)
    points = np.append(0, np.cumsum(~query))
    return _paired(times[at], tree.below(points[_starts(group)[at]], points[at], bound[at]))


def _before_in_both(group: np.ndarray, first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray], query: np.ndarray, times: np.ndarray) -> int:
    """Pairs of a query and a point before it in the rows' order, of its group, whose two numbers are below the query's bounds.

    Rows are compared one by one within small squares; from there on the halves of ever larger stretches are: points of the left
    half and queries of the right one, by the one number's order and a tree over the other.
    """
    n = len(query)
    if not query.any() or query.all():
        return 0
    if first[0].max() < second[0].max():  # the tree has a level for each bit
        first, second = second, first
    square = lambda a: np.append(a, np.zeros(-n % _SQUARE, a.dtype)).reshape(-1, _SQUARE)
    asked, weight = square(np.where(query, times, 0)), square(np.where(query, 0, times).astype(np.float64))
    tests = [(square(v), square(bound)) for v, bound in (first, second)]
    same, lower, total = square(group), np.tri(_SQUARE, k=-1, dtype=bool), 0
    for at in range(0, len(same), 64):
        part = slice(at, at + 64)
        good = lower & (same[part, None, :] == same[part, :, None])
        for v, bound in tests:
            good &= v[part, None, :] < bound[part, :, None]
        total += _paired(asked[part].ravel(), np.matmul(good.astype(np.float64), weight[part, :, None]).astype(np.int64).ravel())
    sorted_ = np.argsort(2 * np.where(query, first[1] - 1, first[0]) + query, kind="stable")
    half, groups = _SQUARE, int(group.max()) + 1
    while half < n:
        rows = sorted_[(sorted_ // half & 1 == 1) == query[sorted_]]
        node = rows // (2 * half) * groups + group[rows]
        order = np.argsort(node, kind="stable")
        rows = rows[order]
        if len(rows):
            total += _before(node[order], second[0][rows], second[1][rows], query[rows], times[rows])
        half *= 2
    return total


def _numbers(column: pa.ChunkedArray, kind: tuple[bool, bool]) -> tuple[np.ndarray, np.ndarray]:
    """For values of an order predicate their numbers, and the bounds below which a query counts them."""
    values, number = np.unique(column.to_numpy(), return_inverse=True)
    number = len(values) - 1 - number if kind[0] else number
    return number, number + kind[1]


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal numbers for equal values of a column."""
    return np.asarray(column.combine_chunks().dictionary_encode().indices)


def _table(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


_TOTAL = "pairs decimal(38,0)"
_DECIMAL = pa.decimal128(38, 0)


def _total(df: DataFrame) -> int:
    return int(df.agg(F.sum("pairs")).first()[0] or 0)


def _ordered(column: str, greater: bool) -> Column:
    """Points first that a query may count."""
    return F.col(column).desc() if greater else F.col(column).asc()


def count_dominated(events: DataFrame, first: tuple[bool, bool], second: tuple[bool, bool], scratch: Scratch) -> int:
    """Pairs of a query and a point of one group whose x and y are in order.

    ``events``: g, x, y, query, n (rows that agree in all else). ``first`` and ``second``: for x and y whether the point's value must be greater, and
    whether an equal one counts. A task holds one range of rows, whatever the share of one group or value.
    """
    late = lambda inclusive: F.col("query") if inclusive else ~F.col("query")  # noqa: E731  of equal values, who comes first
    order = [F.col("g"), _ordered("x", first[0]), late(first[1]), _ordered("y", second[0])]
    y_type = events.schema["y"].dataType.simpleString()

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _table(batches)
        if rows is None:
            return
        query, times = rows.column("query").to_numpy(), rows.column("n").to_numpy()
        pairs = _before(_codes(rows.column("g")), *_numbers(rows.column("y"), second), query, times)
        part = np.full(len(query), TaskContext.get().partitionId(), np.int64)
        found = pa.array([pairs] + [None] * (len(query) - 1), _DECIMAL)
        yield from pa.table([*(rows.column(c) for c in ("g", "y", "query", "n")), part, found], names=["g", "y", "query", "n", "part", "pairs"]).to_batches(max_chunksize=10_000)

    placed = events.repartitionByRange(*order).sortWithinPartitions(*order).select("g", "y", "query", "n")
    placed = scratch.put(placed.mapInArrow(inside, f"g string, y {y_type}, query boolean, n long, part long, {_TOTAL}"), "placed")
    total = _total(placed)
    wide = placed.groupBy("g").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a < b").select("g")
    wide = scratch.put(wide, "wide")  # fewer than there are ranges
    if wide.isEmpty():
        return total
    order = [F.col("g"), _ordered("y", second[0]), late(second[1]), F.col("part")]
    rows = placed.join(F.broadcast(wide), "g").groupBy("g", "y", "query", "part").agg(F.sum("n").alias("n"))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _table(batches)
        if rows is None:
            return
        query, times, part = rows.column("query").to_numpy(), rows.column("n").to_numpy(), rows.column("part").to_numpy()
        group = _codes(rows.column("g"))
        pairs = _before(group, part, part, query, times)
        cell = np.unique(np.stack((group, part), 1), axis=0, return_index=True, return_inverse=True)
        of = cell[2].ravel()
        sums = [np.bincount(of[side], times[side].astype(np.float64), len(cell[1])).astype(np.int64) for side in (query, ~query)]
        me = np.full(len(cell[1]), TaskContext.get().partitionId(), np.int64)
        yield pa.RecordBatch.from_arrays([rows.column("g").combine_chunks().take(pa.array(cell[1])), pa.array(part[cell[1]]), pa.array(me), pa.array(sums[0]), pa.array(sums[1]), pa.array([pairs] + [None] * (len(me) - 1), _DECIMAL)], names=["g", "part", "other", "queries", "points", "pairs"])

    cells = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("g", "query", "n", "part")
    cells = scratch.put(cells.mapInArrow(across, f"g string, part long, other long, queries long, points long, {_TOTAL}"), "cells")

    def by_cell(rows: pa.Table) -> pa.Table:
        part, other, queries, points = (rows.column(c).to_numpy() for c in ("part", "other", "queries", "points"))
        # queries before points within a range, as only lower ranges count
        place, both = np.lexsort((np.tile(other, 2), np.repeat([False, True], len(part)), np.tile(part, 2))), np.repeat([True, False], len(part))
        times, number = np.concatenate((queries, points))[place], np.tile(other, 2)[place]
        return pa.table([pa.array([_before(np.zeros(len(place), np.int64), number, number, both[place], times)], _DECIMAL)], names=["pairs"])

    return total + _total(cells) + _total(cells.groupBy("g").applyInArrow(by_cell, _TOTAL))  # ranges squared at most in a group


def count_dominated_in_three(events: DataFrame, kinds: list[tuple[bool, bool]], scratch: Scratch) -> int:
    """Pairs of a query and a point of one group whose x, y and z are in order; ``events`` and ``kinds`` as for two, with z."""
    events = scratch.put(events, "events")
    x_type, y_type = (events.schema[c].dataType.simpleString() for c in "xy")
    ranges = min(_MOST_RANGES, 1 + events.count() // _RANGE)

    def order(c: str, kind: tuple[bool, bool], *ties: str) -> list[Column]:
        return [F.col("g"), _ordered(c, kind[0]), F.col("query") if kind[1] else ~F.col("query"), *map(F.col, ties)]

    def placed(rows: DataFrame, by: list[Column], run, names: list[str], schema: str, name: str) -> DataFrame:
        return scratch.put(rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by).select(*names).mapInArrow(run, schema), name)

    def with_range(rows: pa.Table, names: list[str], part: str, pairs: int) -> Iterator[pa.RecordBatch]:
        here, found = np.full(rows.num_rows, TaskContext.get().partitionId(), np.int64), pa.array([pairs] + [None] * (rows.num_rows - 1), _DECIMAL)
        yield from pa.table([*(rows.column(c) for c in names), here, found], names=[*names, part, "pairs"]).to_batches(max_chunksize=10_000)

    def read(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _codes(rows.column("g")), rows.column("query").to_numpy(), rows.column("n").to_numpy()

    def coarse(rows: pa.Table, c: str) -> tuple[np.ndarray, np.ndarray]:
        part = rows.column(c).to_numpy()
        return part, part

    def by_z(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _table(batches)
        if rows is not None:
            group, query, times = read(rows)
            pairs = _before_in_both(group, _numbers(rows.column("x"), kinds[0]), _numbers(rows.column("y"), kinds[1]), query, times)
            yield from with_range(rows, ["g", "x", "y", "query", "n"], "pz", pairs)

    def by_x(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _table(batches)
        if rows is not None:
            group, query, times = read(rows)
            pairs = _before_in_both(group, _numbers(rows.column("y"), kinds[1]), coarse(rows, "pz"), query, times)
            yield from with_range(rows, ["g", "y", "query", "n", "pz"], "px", pairs)

    def by_y(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _table(batches)
        if rows is not None:
            group, query, times = read(rows)
            pairs = _before_in_both(group, coarse(rows, "pz"), coarse(rows, "px"), query, times)
            cells = rows.group_by(["g", "query", "pz", "px"]).aggregate([("n", "sum")]).rename_columns(["g", "query", "pz", "px", "n"])
            yield from with_range(cells, ["g", "query", "n", "pz", "px"], "py", pairs)

    first = placed(events, order("z", kinds[2], "x", "y"), by_z, ["g", "x", "y", "query", "n"], f"g string, x {x_type}, y {y_type}, query boolean, n long, pz long, {_TOTAL}", "by_z")
    total = _total(first)
    wide = scratch.put(first.groupBy("g").agg(F.min("pz").alias("a"), F.max("pz").alias("b")).filter("a < b").select("g"), "wide")  # fewer than there are ranges
    if wide.isEmpty():
        return total
    scratch.drop("events")
    first = first.drop("pairs").join(F.broadcast(wide), "g")
    second = placed(first, order("x", kinds[0], "pz", "y"), by_x, ["g", "y", "query", "n", "pz"], f"g string, y {y_type}, query boolean, n long, pz long, px long, {_TOTAL}", "by_x")
    total += _total(second)
    scratch.drop("by_z")
    third = placed(second.drop("pairs"), order("y", kinds[1], "pz", "px"), by_y, ["g", "query", "n", "pz", "px"], f"g string, query boolean, n long, pz long, px long, py long, {_TOTAL}", "by_y")
    scratch.drop("by_x")

    def by_cell(rows: pa.Table) -> pa.Table:
        query, part = rows.column("query").to_numpy(), rows.column("pz").to_numpy()
        rows = rows.take(pa.array(np.lexsort((~query, part))))  # queries before points within a range, as only lower ranges count
        zero = np.zeros(rows.num_rows, np.int64)
        return pa.table([pa.array([_before_in_both(zero, coarse(rows, "px"), coarse(rows, "py"), *read(rows)[1:])], _DECIMAL)], names=["pairs"])

    return total + _total(third) + _total(third.drop("pairs").groupBy("g").applyInArrow(by_cell, _TOTAL))  # cells of ranges: their third power at most


def _turned(predicate: Predicate) -> Predicate:
    """The predicate with the left row first."""
    i, a, op, j, b = predicate
    return (j, b, _TURNED.get(op, op), i, a) if (i, j) == (1, 0) else predicate


def _events(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Queries and points with their numbers. Groups are told apart by their values as JSON, in which zeros have no sign."""
    sides = [side.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).withColumn("query", F.lit(q)) for side, q in ((left, True), (right, False))]
    both = sides[0].unionByName(sides[1])
    plain = [F.col(c) + F.lit(0.0) if both.schema[c].dataType.simpleString() in ("double", "float") else F.col(c) for c in names if c.startswith("g")]
    return both.withColumn("g", F.to_json(F.struct(*[c.alias(f"k{k}") for k, c in enumerate(plain)])) if plain else F.lit(""))


def _term(left: DataFrame, right: DataFrame, equal: list[Predicate], order: list[Predicate]) -> int:
    """Pairs that fulfil equalities and up to three order predicates."""
    scratch = Scratch(left.sparkSession)
    names = [f"g{k}" for k in range(len(equal))] + ["x", "y", "z"][: len(order)]
    side = lambda df, at: df.select(*[F.col(p[at]).alias(n) for n, p in zip(names, [*equal, *order], strict=True)])
    if not names:
        return left.count() * right.count()
    events = _events(side(left, 1), side(right, 4), names)
    if not order:
        groups = events.groupBy("g").agg(F.sum(F.when(F.col("query"), F.col("n")).cast("decimal(19,0)")).alias("l"), F.sum(F.when(~F.col("query"), F.col("n")).cast("decimal(19,0)")).alias("r"))
        return int(groups.agg(F.sum((F.col("l") * F.col("r")).cast("decimal(38,0)"))).first()[0] or 0)
    if len(order) == 1:
        events = events.withColumn("y", F.lit(0))
    kinds = [_ORDERS[p[2]] for p in order]
    if len(order) == 3:
        return count_dominated_in_three(events.select("g", "x", "y", "z", "query", "n"), kinds, scratch)
    return count_dominated(events.select("g", "x", "y", "query", "n"), kinds[0], kinds[1] if len(order) > 1 else (False, True), scratch)


def count_violations(rows: DataFrame, dc: list[Predicate]) -> int:
    """Ordered pairs of different rows that fulfil every predicate of a constraint; a pair without a value on either side does not count.

    Up to three order predicates between the rows and any number of others. Repeated rows are rows, so each meets its copies.
    A predicate that isn't known holds for no pair. Predicates about one row alone filter that row.
    """
    dc = [_turned(p) for p in dc]
    order = [p for p in dc if p[2] in _ORDERS and p[0] != p[3]]
    unequal = [p for p in dc if p[2] in _UNEQUAL and p[0] != p[3]]
    equal = [p for p in dc if p[2] in _EQUAL and p[0] != p[3]]
    alone = [p for p in dc if p[0] == p[3]]
    if len(order) + len(unequal) + len(equal) + len(alone) < len(dc) or any(p[2] not in (*_ORDERS, *_EQUAL, *_UNEQUAL) for p in alone):
        return 0
    if len(order) > 3:
        raise ValueError("at most three order predicates can be counted")

    def usable(at: int) -> DataFrame:
        used = {p[k + 1] for p in dc for k in (0, 3) if p[k] == at}
        tests = [F.col(c).isNotNull() for c in used] + [holds(F.col(p[1]), p[2], F.col(p[4])) for p in alone if p[0] == at]
        return rows.filter(reduce(Column.__and__, tests)) if tests else rows

    left, right = usable(0), usable(1)
    total = 0
    for taken in product((False, True), repeat=len(unequal)):
        more = [p for p, t in zip(unequal, taken, strict=True) if t]
        total += (-1) ** len(more) * _term(left, right, equal + more, order)
    itself = [holds(F.col(p[1]), p[2], F.col(p[4])) for p in dc]
    return total - rows.filter(reduce(Column.__and__, itself)).count()


def violation_counts(rows: DataFrame, constraints: list[list[Predicate]], first_id: int = 1) -> DataFrame:
    """(dc_id, n_pairs): how many ordered pairs of different rows violate each constraint. n_pairs is a decimal, as it may exceed a BIGINT."""
    with ThreadPoolExecutor(4) as pool:  # constraints don't wait for each other
        counts = list(enumerate(pool.map(lambda dc: count_violations(rows, dc), constraints), first_id))
    return rows.sparkSession.createDataFrame([(k, str(n)) for k, n in counts], "dc_id int, n string").select("dc_id", F.col("n").cast("decimal(38,0)").alias("n_pairs"))


def close_pairs(rows: DataFrame, near: dict[str, int | float], equal: list[str] | None = None) -> int:
    """Unordered pairs of different rows whose values differ by at most the given bound in one or two columns, and agree in others.

    Each bound makes an interval around a row's value, so a pair lies in a rectangle, and four counts of pairs in order give the number in it:
    no pair is made, however many rows are alike. Rows with a null in a column take no part. Bounds are added to values in their own type, so
    whole numbers and decimals are exact.
    """
    columns, agree = list(near), equal or []
    if not 1 <= len(columns) <= 2 or any(not v >= 0 for v in near.values()):
        raise ValueError("one or two columns with bounds of at least 0 are needed")
    scratch = Scratch(rows.sparkSession)
    used = rows.select(*[F.col(f"`{c}`").alias(f"g{i}") for i, c in enumerate(agree)], *[F.col(f"`{c}`").alias(n) for n, c in zip("xy", columns, strict=False)])
    used = scratch.put(used.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in used.columns])), "used")
    total = 0
    # values at most v + bound, less those below v - bound, in each column
    for ends in product((True, False), repeat=len(columns)):
        moved = used
        for name, column, upper in zip("xy", columns, ends, strict=False):
            bound = F.lit(near[column] if upper else -near[column])
            moved = moved.withColumn(name, F.col(name) + bound)
        kinds = [(False, upper) for upper in ends]
        events = _events(moved, used, used.columns)
        if len(columns) == 1:
            events, kinds = events.withColumn("y", F.lit(0)), [*kinds, (False, True)]
        total += (-1) ** ends.count(False) * count_dominated(events.select("g", "x", "y", "query", "n"), kinds[0], kinds[1], Scratch(rows.sparkSession))
    return (total - used.count()) // 2


def exact_support(rows: DataFrame, left: tuple[str, float], right: tuple[str, float], *, least: float = 0.9, equal: list[str] | None = None) -> DataFrame:
    """(n_close, n_both, support, valid) of a differential dependency over all pairs of rows: of those close in one column (and alike in ``equal``)
    the share that is close in the other. 0 if none is."""
    n_close = close_pairs(rows.filter(F.col(f"`{right[0]}`").isNotNull()), {left[0]: left[1]}, equal)
    n_both = close_pairs(rows, dict([left, right]), equal)
    support = n_both / n_close if n_close else 0.0
    return rows.sparkSession.createDataFrame([(str(n_close), str(n_both), support, support >= least)], "c string, b string, support double, valid boolean").select(
        F.col("c").cast("decimal(38,0)").alias("n_close"), F.col("b").cast("decimal(38,0)").alias("n_both"), "support", "valid"
    )
