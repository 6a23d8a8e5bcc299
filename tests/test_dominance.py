"""Counts of violating pairs against all pairs, one by one."""

import operator
import random

import numpy as np
import pytest

from veilgraph.operators.dominance import Tree, close_pairs, count_violations, exact_support, violation_counts

OPS = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def brute(rows, names, dc):
    at = {n: i for i, n in enumerate(names)}
    total = 0
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i == j:
                continue
            both = (a, b)
            values = [(both[p[0]][at[p[1]]], p[2], both[p[3]][at[p[4]]]) for p in dc]
            total += all(x is not None and y is not None and OPS[op](x, y) for x, op, y in values)
    return total


def test_tree_sums_match_loops():
    rng = np.random.default_rng(2)
    number, weight = rng.integers(0, 13, 200), rng.integers(0, 9, 200)
    a = rng.integers(0, 201, 300)
    b = np.maximum(a, rng.integers(0, 201, 300))
    bound = rng.integers(0, 14, 300)
    want = [sum(int(w) for v, w in zip(number[i:j], weight[i:j]) if v < k) for i, j, k in zip(a, b, bound)]
    assert Tree(number, weight, 13).below(a, b, bound).tolist() == want


DCS = [
    [(0, "a", "<", 1, "a"), (0, "b", ">", 1, "b")],
    [(0, "a", "<=", 1, "a"), (0, "b", ">=", 1, "b")],
    [(0, "s", "!=", 1, "s"), (0, "a", "<=", 1, "a")],
    [(0, "s", "==", 1, "s"), (0, "a", "<", 1, "b"), (0, "b", "<=", 1, "b")],
    [(0, "s", "!=", 1, "s"), (0, "t", "!=", 1, "t")],
    [(0, "a", "<", 1, "a"), (0, "b", "<=", 1, "b"), (0, "c", ">", 1, "c")],
    [(0, "s", "==", 1, "s"), (0, "c", ">=", 1, "c"), (0, "a", ">=", 1, "a"), (0, "b", ">", 1, "b")],
    [(1, "a", "<", 0, "b"), (0, "a", "<", 0, "c")],
    [(0, "a", "~", 1, "a")],
    [(0, "c", "!=", 1, "c")],
]


@pytest.mark.parametrize("ranges", [1, 7])
def test_counts_match_all_pairs(spark, ranges):
    rng = random.Random(ranges)
    names = ["a", "b", "c", "s", "t"]
    rows = [(rng.choice([None, 0, 0, 0, 1, 2, 9]), rng.randint(0, 6), rng.choice([None, -0.0, 0.0, 1.5, 2.5]), rng.choice("xxxxyz"), rng.choice([None, "p", "q"])) for _ in range(150)]
    rows += [rows[0]] * 12  # repeated rows, and one value of a third of all
    rows += [(0, 3, 1.5, "x", "p")] * 60
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that groups lie in several ranges
    try:
        df = spark.createDataFrame(rows, "a long, b int, c double, s string, t string").repartition(3).cache()
        got = {r.dc_id: int(r.n_pairs) for r in violation_counts(df, DCS).collect()}
        df.unpersist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert got == {k + 1: brute(rows, names, dc) if dc[0][2] in OPS else 0 for k, dc in enumerate(DCS)}


def test_empty_tables_and_too_many_orders(spark):
    empty = spark.createDataFrame([], "a long, b int, c double, s string, t string")
    assert [int(r.n_pairs) for r in violation_counts(empty, DCS).collect()] == [0] * len(DCS)
    with pytest.raises(ValueError, match="three order"):
        count_violations(empty, [(0, "a", "<", 1, "a")] * 4)


def test_close_pairs_match_all_pairs(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, rng.randint(-5, 5)]), rng.randint(0, 4), rng.choice(["p", "q", None])) for _ in range(120)] + [(1, 2, "p")] * 40
    df = spark.createDataFrame(rows, "a int, b long, s string").repartition(4)

    def brute(a, b, same):
        kept = [r for r in rows if r[0] is not None and (not same or r[2] is not None)]
        return sum((b is None or abs(x[1] - y[1]) <= b) and abs(x[0] - y[0]) <= a and (not same or x[2] == y[2]) for i, x in enumerate(kept) for y in kept[:i])

    assert close_pairs(df, {"a": 2}) == brute(2, None, False)
    assert close_pairs(df, {"a": 0, "b": 1}) == brute(0, 1, False)
    assert close_pairs(df, {"a": 3, "b": 0}, ["s"]) == brute(3, 0, True)
    r = exact_support(df, ("a", 2), ("b", 1)).first()
    assert (int(r.n_close), int(r.n_both)) == (brute(2, None, False), brute(2, 1, False)) and r.support == brute(2, 1, False) / brute(2, None, False)
    assert exact_support(df.limit(0), ("a", 2), ("b", 1)).first().support == 0
    with pytest.raises(ValueError, match="bounds"):
        close_pairs(df, {"a": -1})


def test_three_order_predicates_move_no_more_rows_than_there_are(spark, monkeypatch):
    """Each pass writes a row for each query and point at most, in many ranges and in one, and the count is that of all pairs."""
    from veilgraph.operators import dominance

    rng = random.Random(5)
    names = ["a", "b", "c", "s"]
    rows = [(rng.randint(0, 40), rng.choice([-0.0, 0.0, 0.5, 7.0]), rng.randint(0, 300), rng.choice("xxxy")) for _ in range(400)]
    kept = []
    put = dominance.Scratch.put

    def counted(self, df, name):
        out = put(self, df, name)
        kept.append(out.count())
        return out

    monkeypatch.setattr(dominance.Scratch, "put", counted)
    table = spark.createDataFrame(rows, "a int, b double, c int, s string")
    for rows_of_range in (10_000, 60):
        monkeypatch.setattr(dominance, "_RANGE", rows_of_range, raising=False)
        monkeypatch.setattr(dominance, "_SQUARE", 8, raising=False)
        for dc in ([(0, "a", "<", 1, "a"), (0, "b", ">=", 1, "b"), (0, "c", "<", 1, "c")], [(0, "s", "==", 1, "s"), (0, "a", ">", 1, "a"), (0, "b", "<=", 1, "b"), (0, "c", "<=", 1, "a")]):
            kept.clear()
            assert count_violations(table, dc) == brute(rows, names, dc)
            assert max(kept) <= 2 * len(rows)
