"""Queries over operators whose work must not grow with pairs of rows, copies of rows or sets of masks."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from veilgraph.operators import dominance, mechanisms, partitions
from veilgraph.plans import mined
from veilgraph.plans.driver import EM_SQL, ORDER_DCS, TARGET_SQL, _constraints, _em, _hash_sql, query, table

#: Constraints whose violating pairs are counted: those of orders, and one of three order predicates.
COUNTED = [*ORDER_DCS, [(0, "o_totalprice", "<", 1, "o_totalprice"), (0, "o_custkey", ">=", 1, "o_custkey"), (0, "o_orderkey", "<", 1, "o_orderkey")]]


def _pairs_sql() -> str:
    parts = []
    for k, dc in enumerate(COUNTED):
        tests = " AND ".join(f"a.{c} {'=' if op == '==' else op} b.{d}" for _, c, op, _, d in dc)
        parts.append(f"SELECT {k + 1} AS dc_id, count(*) AS n_pairs FROM orders a JOIN orders b ON {tests} AND a.o_orderkey != b.o_orderkey")
    return " UNION ALL ".join(parts)


@query(_pairs_sql())
def dc_violation_counts(spark, sf_dir):
    """How many pairs of orders violate each constraint, inequalities alone included, without making the pairs."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return dominance.violation_counts(orders, COUNTED).select("dc_id", F.col("n_pairs").cast("long").alias("n_pairs"))


LINE_COLUMNS = ["l_discount", "l_extendedprice", "l_linenumber", "l_linestatus", "l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate", "l_suppkey", "l_tax"]


def _all_sql() -> str:
    """Counts of all sets of up to four columns at once; each set and right side is a smaller set's classes and their largest parts."""
    columns = LINE_COLUMNS
    sets = ", ".join("(" + ", ".join(c) + ")" for k in (2, 3, 4) for c in combinations(columns, k))
    inside = " + ".join(f"(1 - GROUPING({c})) * {1 << i}" for i, c in enumerate(columns))
    rest = ", ".join(f"CASE WHEN r = {i} THEN NULL ELSE {c} END AS {c}" for i, c in enumerate(columns))
    rhs = "CASE r " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(columns)) + " END"
    lhs = "concat_ws(',', " + ", ".join(f"CASE WHEN s & {1 << i} != 0 AND r != {i} THEN '{c}' END" for i, c in enumerate(columns)) + ")"
    return f"""WITH g AS (SELECT {inside} AS s, {", ".join(columns)}, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ({sets})),
 x AS (SELECT s, r, {rest}, n FROM g, (SELECT unnest(range(0, {len(columns)}))::INTEGER AS r) WHERE s & (1 << r) != 0),
 t AS (SELECT s, r, sum(n) AS n, max(n) AS top FROM x GROUP BY s, r, {", ".join(columns)})
 SELECT {lhs} AS lhs, {rhs} AS rhs, sum(n)::BIGINT AS n, sum(n - top)::BIGINT AS errors, round(sum(n - top) / sum(n)::DOUBLE, 9) AS g3, sum(n - top) / sum(n)::DOUBLE <= 0.05 AS valid FROM t GROUP BY s, r"""


@query(_all_sql())
def afd_discovery_all(spark, sf_dir):
    """g3 of every set of up to three columns of line items towards every other column."""
    found = partitions.discover_all(table(spark, sf_dir, "lineitem"), LINE_COLUMNS, 3)
    return found.select("lhs", "rhs", "n", "errors", F.round("g3", 9).alias("g3"), "valid")


@query(f"""{EM_SQL}, gb AS (SELECT ds, n, mask, eps, cap, u, it, ({_hash_sql("'11'", "ds", TARGET_SQL, "eps::VARCHAR", "cap::VARCHAR", "mask::VARCHAR", "it::VARCHAR")} + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS v FROM em, (SELECT unnest(range(0, 5)) AS it))
 SELECT ds AS dataset, eps AS epsilon, cap, it::INTEGER AS iteration, arg_max(mask, (eps * u * n / 2 - ln(-ln(v)), mask)) AS mask FROM gb GROUP BY ALL""")
def em_gumbel(spark, sf_dir):
    """Five draws at each point by the largest noisy score."""
    return mechanisms.gumbel_draw(_em(spark, sf_dir), 5, seed=11).select("dataset", "epsilon", "cap", "iteration", "mask")


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS s, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part), q AS (SELECT abs(a.s - b.s) <= 5 AS near, abs(a.c - b.c) <= 1000 AS too FROM p a JOIN p b ON a.k < b.k)
 SELECT count(*) FILTER (near) AS n_close, count(*) FILTER (near AND too) AS n_both, round(count(*) FILTER (near AND too) / count(*) FILTER (near)::DOUBLE, 9) AS support, count(*) FILTER (near AND too) / count(*) FILTER (near)::DOUBLE >= 0.9 AS valid FROM q""")
def dd_support_exact(spark, sf_dir):
    """How often parts close in size are close in price, over all pairs, without making the pairs."""
    parts = table(spark, sf_dir, "part").select("p_size", F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"))
    found = dominance.exact_support(parts, ("p_size", 5), ("cents", 1000))
    return found.select(F.col("n_close").cast("long").alias("n_close"), F.col("n_both").cast("long").alias("n_both"), F.round("support", 9).alias("support"), "valid")


@query(f"WITH {mined.WEIGHTS_SQL} SELECT ds AS dataset, dc_id::INTEGER AS dc_id, w AS weight FROM z_w WHERE w > 0")
def mined_weights(spark, sf_dir):
    """The constraints over the tables that keep a weight, as the leakage queries use them; mined once in a session."""
    return _constraints(spark, sf_dir).filter(F.col("dataset").isin(*mined.SOURCES)).select("dataset", "dc_id", "weight")
