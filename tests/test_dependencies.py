"""Bounds, pair statistics and dependency weights on small tables worked by hand."""

import math
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from veilgraph.functions import expressions as X
from veilgraph.operators import dependencies as D
from veilgraph.operators import pairs as P
from veilgraph.operators import weights as W
from veilgraph.store import Scratch


@pytest.mark.parametrize("k,n,low,high", [(0, 10, 0, 0.212941970083), (5, 10, 0.269271821138, 0.730728178862), (10, 10, 0.787058029917, 1), (180, 200, 0.859593373755, 0.929728897722), (0, 0, 0, 1)])
def test_wilson(spark, k, n, low, high):
    a, b = X.wilson(F.lit(k), F.lit(n))
    got = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    assert math.isclose(got.a, low, abs_tol=1e-11) and math.isclose(got.b, high, abs_tol=1e-11)


def test_base_of_a_direction(spark):
    counts = spark.createDataFrame([(1, 2, 0, 300000, 120000, 6000, 5800), (2, 2, 0, 199, 1, 5, 5), (3, 2, 0, 300, 300, 5, 5), (4, 2, 0, 300, 1, 0, 0)], "dc_id int, m int, head_j int, nV long, k0 long, nE long, k1 long")
    got = {r.dc_id: r for r in W.direction_stats(counts).collect()}
    assert math.isclose(got[1].UCB0, 0.401472097291, abs_tol=1e-11) and math.isclose(got[1].LCB1, 0.962639595769, abs_tol=1e-11) and math.isclose(got[1].base, 0.937579511228, abs_tol=1e-11)
    assert [(got[i].base, got[i].nE) for i in (2, 3, 4)] == [(0, 0), (0, 0), (0, 0)]


def test_best_heads_and_gammas(spark):
    stats = spark.createDataFrame([(1, 2, 0, 900, 60, 0.6), (1, 2, 1, 900, 70, 0.6), (2, 2, 0, 900, 10, 0.9), (2, 2, 1, 900, 0, 0.0), (3, 1, 0, 900, 80, -0.5)], "dc_id int, m int, head_j int, nV long, nE long, base double").withColumns({"UCB0": F.lit(0.0), "LCB1": F.lit(0.0)})
    best = W.best_heads(stats, 50)
    got = {r.dc_id: (r.best_head_j, r.nE_best, r.best_base) for r in best.collect()}
    assert got == {1: (0, 60, 0.6), 2: (-1, 0, 0.0), 3: (0, 80, 0.0)}
    weights = {(r.dc_id, r.gamma): r.weight for r in W.with_gammas(best).collect()}
    assert math.isclose(weights[1, 0.25], 0.35) and math.isclose(weights[1, 0.5], 0.1) and weights[2, 0.25] == 0
    assert W.kept_weights(W.with_gammas(best)).count() == 2
    assert {r.gamma: r.n_kept for r in W.gamma_sweep(best).collect()} == {0.05: 1, 0.1: 1, 0.15: 1, 0.25: 1, 0.5: 1}


def test_counts_match_a_loop(spark):
    rows = [(i, i % 3, i % 4 if i % 5 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, a int, b int")
    dc = [(0, "a", "==", 1, "a"), (0, "b", "!=", 1, "b")]
    sample = P.sample_pairs(df, "k", 500)
    listed = sample.collect()
    assert len(listed) == 500 and all(r.l_k != r.r_k for r in listed)
    got = {r.head_j: (r.nV, r.k0, r.nE, r.k1) for r in W.direction_counts(sample, [dc]).collect()}
    ok = [r for r in listed if None not in (r.l_a, r.r_a, r.l_b, r.r_b)]
    eq, ne = (lambda r: r.l_a == r.r_a), (lambda r: r.l_b != r.r_b)
    for j, (head, other) in enumerate(((eq, ne), (ne, eq))):
        premise = [r for r in ok if other(r)]
        assert got[j] == (len(ok), sum(not head(r) for r in ok), len(premise), sum(not head(r) for r in premise))


def test_sample_is_repeatable_and_needs_two_rows(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    one, two = (sorted((r.pair, r.l_k, r.r_k) for r in P.sample_pairs(df.repartition(n), "k", 200).collect()) for n in (1, 5))
    assert one == two
    with pytest.raises(ValueError):
        P.sample_pairs(df.limit(1), "k", 5)


def test_numbers_are_dense_over_many_ranges(spark):
    """Wide rows in several partitions of very different widths, so that a second run would be cut elsewhere."""
    df = spark.range(200_000).select((F.col("id") * 7919 % 1_000_003).alias("k"), F.repeat(F.lit("wide "), (F.col("id") % 60).cast("int")).alias("text"), F.rand(1).alias("x")).repartition(9)
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        got = P.numbered(df, "k", Scratch(spark)).orderBy("k").collect()
        assert [r.rn for r in got] == list(range(200_000))
        sample = P.sample_pairs(df, "k", 20_000).select("pair", "l_k", "r_k", "l_text").collect()
        assert sorted(r.pair for r in sample) == list(range(20_000)) and all(r.l_k != r.r_k for r in sample)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old[1])


def test_rows_without_a_key_and_repeated_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "k int, t string")
    rows = P.sample_pairs(df, "k", 50).collect()
    assert len(rows) == 50 and {r.l_k for r in rows} == {1, 2}


def test_violations(spark):
    rows = [(1, "a", 1), (2, "a", 2), (3, "a", None), (4, "b", 1), (5, None, 9), (6, None, 8)]
    df = spark.createDataFrame(rows, "k int, x string, y int")
    got = {tuple(r) for r in P.violations(df, "k", [(0, "x", "==", 1, "x"), (0, "y", "<", 1, "y")]).collect()}
    assert got == {(1, 2)}
    with pytest.raises(ValueError):
        P.violations(spark.range(30_000).withColumnRenamed("id", "k"), "k", [(0, "k", "<", 1, "k")])


@pytest.mark.parametrize("op,want", [("EQUAL", False), ("<>", True), ("LESS_OR_EQUAL", True), (">", False), ("GREATER_EQUAL", False), ("<", True), ("like", False)])
def test_operators(spark, op, want):
    assert spark.range(1).select(X.holds(F.lit(1), op, F.lit(2))).first()[0] is want


PEOPLE = [(25, 20, "flu"), (25, 20, "flu"), (25, 20, "cold"), (30, 22, "cold"), (30, 22, "cold"), (40, 25, "flu"), (40, 25, "flu"), (50, 30, "cold")]


def test_g3(spark):
    df = spark.createDataFrame(PEOPLE, "age int, bmi int, dx string")
    got = D.g3_error(df, ["age", "bmi"], "dx", 0.15).first()
    assert (got.g3, got.weight, got.valid, got.errors) == (0.125, 0.875, True, 1)
    found = {r.lhs: (r.n, r.errors) for r in D.discover(df.union(spark.createDataFrame([(None, 20, "flu")], df.schema)), ["age", "bmi"], "dx").collect()}
    assert found == {"age": (9, 1), "bmi": (9, 1), "age,bmi": (9, 1)}
    assert D.g3_error(df.limit(0), ["age"], "dx").first().g3 == 0


def test_conditional_probability_and_information(spark):
    rows = [("1", "A", 20, "x"), ("1", "A", 21, "y"), ("2", "B", 22, "x"), ("2", "B", 23, "y"), ("3", "C", 24, "x"), ("3", "C", 25, "x"), (None, "C", None, "x")]
    df = spark.createDataFrame(rows, "zip string, city string, age int, dx string")
    got = D.conditional_probability(df, ["zip"], "city").first()
    assert (got.avg_prob, got.worst_prob, got.n_contexts) == (1.0, 1.0, 3)
    half = D.conditional_probability(df, ["zip"], "dx").first()
    assert math.isclose(half.avg_prob, 4 / 6) and half.worst_prob == 0.5
    assert math.isclose(D.information_gain(df, ["age"], "dx").first().gain, 1.0)
    assert D.information_gain(df.filter("dx = 'x'"), ["zip"], "dx").first().gain == 1.0
    assert 0 < D.information_gain(df, ["zip"], "dx").first().gain < 1
    assert D.dependency_weight(df, ["zip"], "dx", "worst_case").first().weight == 0.5
    with pytest.raises(ValueError):
        D.dependency_weight(df, ["zip"], "dx", "other")
    assert D.confidence(df, F.col("age") > 21).first().confidence == 4 / 7


def test_differential_dependencies(spark):
    rows = [(i, i * 2, float(i * 3), "a" if i < 3 else "b") for i in range(8)]
    df = spark.createDataFrame(rows, "k int, x int, y double, s string")
    some = D.sample_distances(df.withColumn("id", F.col("k")), "k", ["id", "x", "y", "s"])
    listed = some.collect()
    assert len(listed) == 28
    d = D.distance(some, ["x", "s"])
    for r in some.withColumn("e", d).collect():
        assert math.isclose(r.e, math.sqrt((r.l_x - r.r_x) ** 2 + (r.l_s != r.r_s)))
    gaps = sorted(abs(a - b) * 2 for a, b in combinations(range(8), 2))
    at = 0.25 * (len(gaps) - 1)
    want = gaps[int(at)] + (at - int(at)) * (gaps[int(at) + 1] - gaps[int(at)])
    assert math.isclose(D.threshold(df, "k", ["x"]).first().theta, want)
    assert math.isclose(D.threshold(df, "k", ["x", "s"]).first().theta, want / 2)
    got = D.differential_support(some, ["x"], ["y"], 4.0, 3.0).first()
    assert (got.n_close, got.n_both) == (13, 7)
    none = D.differential_support(some, ["x"], ["y"], -1.0, 3.0).first()
    assert (none.support, none.valid) == (0.0, False)


def test_all_dependencies_match_counting(spark, monkeypatch):
    import random
    from collections import Counter
    from itertools import combinations

    from veilgraph.operators import partitions

    rng = random.Random(1)
    rows = [(i // 2, rng.choice("ab"), rng.choice([None, 1, 2]), rng.choice([0.0, -0.0, 1.5, None]), i) for i in range(200)]
    rows += [rows[0]] * 5
    names = ["key", "s", "v", "x", "row"]

    def errors(lhs, rhs):
        of = lambda r, c: "null" if r[names.index(c)] is None else r[names.index(c)]
        groups = {}
        for r in rows:
            groups.setdefault(tuple(of(r, c) for c in lhs), Counter())[of(r, rhs)] += 1
        return sum(sum(c.values()) - max(c.values()) for c in groups.values())

    want = {(",".join(x), a): errors(x, a) for k in (1, 2, 3) for x in combinations(sorted(names), k) for a in names if a not in x}
    df = spark.createDataFrame(rows, "key long, s string, v int, x double, row long").repartition(5)
    for sent, block in ((1_000_000, 200_000), (0, 10), (40, 50)):
        monkeypatch.setattr(partitions, "_MOST_SENT", sent)
        monkeypatch.setattr(partitions, "_BLOCK", block)
        found = partitions.discover_all(df, names).collect()
        assert {(r.lhs, r.rhs): r.errors for r in found} == want and {r.n for r in found} == {len(rows)}
    assert {r.errors for r in partitions.discover_all(df.limit(0), names, 1).collect()} == {0}
    with pytest.raises(ValueError, match="columns"):
        partitions.discover_all(df, ["s"])
