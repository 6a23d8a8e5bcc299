"""Queries over the driver's tables and the built-in catalogs, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.functions import expressions as X
from veilgraph.operators import deletion, dependencies, hypergraph, leakage, mechanisms, pairs, report, weights
from veilgraph.plans import mined
from veilgraph.sources import constraints
from veilgraph.store import Scratch, dealt

#: Pairs and rows of the samples that the statistics are made from.
PAIRS = 300_000
SAMPLE = 1000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Constraints over the driver's tables: orders and line items.
ORDER_DCS = [
    [(0, "o_custkey", "==", 1, "o_custkey"), (0, "o_orderstatus", "!=", 1, "o_orderstatus")],
    [(0, "o_orderstatus", "==", 1, "o_orderstatus"), (0, "o_totalprice", "<", 1, "o_totalprice"), (0, "o_orderkey", ">", 1, "o_orderkey")],
    [(0, "o_orderpriority", "!=", 1, "o_orderpriority"), (0, "o_custkey", "<=", 1, "o_custkey")],
    [(0, "o_orderstatus", "==", 1, "o_orderstatus"), (0, "o_orderpriority", "==", 1, "o_orderpriority"), (0, "o_totalprice", ">=", 1, "o_totalprice")],
]
#: Constraints written from columns, as SQL for both engines: text from orders, JSON from parts, rows of a weight file from customers.
TEXT_LINE = """CASE WHEN o_orderkey % 5 = 0 THEN '# ' || o_orderpriority ELSE '  not(t1.' || lower(replace(substr(o_orderpriority, 3), ' ', '-')) || CASE o_orderstatus WHEN 'F' THEN '<>' WHEN 'O' THEN '==' ELSE '<=' END || 't2.city'
 || CASE WHEN o_custkey % 2 = 0 THEN ' and t1.rate >= t2.rate' ELSE '' END || ') ' END"""
_SIDE = '{{"tableIdentifier":"x.csv","columnIdentifier":"{}"}}'
_PRED = '{{"type":"Predicate","column1":{},"index1":{},"op":"{}","column2":{},"index2":{}}}'
_ONE, _TWO = (_PRED.format(_SIDE.format(f"' || {c} || ' str"), i, f"' || {op} || '", _SIDE.format(f"' || {c} || ' str"), j) for c, i, op, j in (("p_type", 0, "CASE WHEN p_size % 2 = 0 THEN 'EQUAL' ELSE 'UNEQUAL' END", "' || (p_size % 3) || '"), ("p_brand", 0, "CASE WHEN p_size % 3 = 0 THEN 'LESS_EQUAL' ELSE 'GREATER' END", 1)))
JSON_LINE = f"""'{{"type":"DenialConstraint","predicates":[' || CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '{_ONE}' WHEN 2 THEN '{_ONE},{_TWO}' WHEN 3 THEN '{_TWO},{_ONE},{_TWO}' ELSE '{_TWO},{_TWO},{_TWO},{_TWO}' END || ']}}'"""
WEIGHTED_LINE = """'t0.' || c_mktsegment || ' str EQUAL t1.' || c_mktsegment || ' str' || CASE WHEN c_custkey % 2 = 0 THEN ' AND t0.Area-Code UNEQUAL t1.Area-Code' ELSE '' END"""


def query(sql: str | None = None):
    """Registers a query, and the SQL that gives its rows, under the function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=8)
def plain_model(dataset: str) -> tuple[list[str], list[tuple[int, int, float]]]:
    """A catalog's zone and coded edges in plain Python, for the oracles: an independent way to the same model."""
    target = constraints.TARGETS[dataset]
    edges = [(sorted(set(re.findall(r"t\d\.([\w\-]+)", line))), w) for w, line in constraints.catalog_lines(dataset)]
    edges = [e for e in edges if len(e[0]) > 1]
    reached, before = {target}, None
    while reached != before:
        before = set(reached)
        for attrs, _ in edges:
            if reached & set(attrs):
                reached |= set(attrs)
    names = sorted(reached - {target})
    bit = {a: 1 << i for i, a in enumerate([*names, target])}
    inside = [(sum(bit[a] for a in attrs), w) for attrs, w in edges if set(attrs) & reached]
    return names, [(i, m, w) for i, (m, w) in enumerate(inside)]


def _catalog_values(kind: str) -> str:
    """The five catalogs' edges (e), models (m) or attributes (n) as rows of VALUES."""
    if kind == "e":
        return ", ".join(f"('{d}', {i}, {m}::BIGINT, {w!r}::DOUBLE)" for d in constraints.DATASETS for i, m, w in plain_model(d)[1])
    if kind == "m":
        return ", ".join(f"('{d}', '{constraints.TARGETS[d]}', {len(plain_model(d)[0])}, {1 << len(plain_model(d)[0])}::BIGINT)" for d in constraints.DATASETS)
    return ", ".join(f"('{d}', {i}, '{a}', {1 << i}::BIGINT)" for d in constraints.DATASETS for i, a in enumerate(plain_model(d)[0]))


#: CTEs e(ds, eid, em, w), m(ds, tg, n, t) and nm(ds, pos, name, bit) of the five catalogs and of what is mined from the tables. Recursive.
MODEL_SQL = f"""{mined.ZONES_SQL},
 e(ds, eid, em, w) AS MATERIALIZED (SELECT * FROM (VALUES {_catalog_values("e")}) UNION ALL SELECT ds, eid, em, w FROM z_e),
 m(ds, tg, n, t) AS MATERIALIZED (SELECT * FROM (VALUES {_catalog_values("m")}) UNION ALL SELECT ds, tg, n, t FROM z_m),
 nm(ds, pos, name, bit) AS MATERIALIZED (SELECT * FROM (VALUES {_catalog_values("n")}) UNION ALL SELECT ds, pos, name, bit FROM z_n)"""
CATALOG_SQL = ", ".join(f"('{d}', {i}, {w!r}::DOUBLE, '{line}')" for d in constraints.DATASETS for i, (w, line) in enumerate(constraints.catalog_lines(d)))
#: c: the constraints of the five catalogs and those mined from the tables.
LINES_SQL = f"{mined.KEPT_SQL}, c(dataset, dc_id, weight, line) AS (SELECT * FROM (VALUES {CATALOG_SQL}) UNION ALL SELECT ds, dc_id, w, line FROM z_k)"
ALL_TARGETS = constraints.TARGETS | mined.TARGETS
MASKS_SQL = "mk AS (SELECT ds, n, t, unnest(range(0, t))::BIGINT AS mask FROM m)"


def _chains_sql() -> str:
    """CTE ch(ds, mask, lvl, rank, eid, w, inf): all chains, by one recursive query over all masks."""
    return f"""RECURSIVE {MODEL_SQL}, {MASKS_SQL},
    st(ds, mask, t, obs, lvl, rank, eid, w, inf, done) AS (
      SELECT ds, mask, t, obs, 0, CASE WHEN fin THEN 0 ELSE row_number() OVER (PARTITION BY ds, mask, fin ORDER BY eid, got) - 1 END, eid, w, got, fin FROM (
        SELECT k.ds, mask, t, ~(mask | t) AS obs, eid, w, CASE WHEN em & t != 0 THEN 0 ELSE em & (mask | t) END AS got, em & t != 0 AS fin
        FROM mk k JOIN e ON e.ds = k.ds
        WHERE (em & t != 0 AND em & (mask | t) = t) OR (em & t = 0 AND bit_count(em & (mask | t)) = 1)
        QUALIFY em & t != 0 OR row_number() OVER (PARTITION BY k.ds, mask, em & t != 0, em & (mask | t) ORDER BY eid) = 1)
      UNION ALL
      SELECT ds, mask, t, obs, lvl + 1, CASE WHEN fin THEN prank ELSE row_number() OVER (PARTITION BY ds, mask, fin ORDER BY prank, eid, got) - 1 END, eid, w, got, fin FROM (
        SELECT s.ds, mask, t, obs, lvl, s.rank AS prank, e.eid, s.w * e.w AS w, em & ~(obs | s.inf) = t AS fin, CASE WHEN em & ~(obs | s.inf) = t THEN s.inf ELSE s.inf | (em & ~(obs | s.inf)) END AS got
        FROM st s JOIN e ON e.ds = s.ds
        WHERE NOT s.done AND bit_count(em & ~(obs | s.inf)) = 1 AND bit_count(em & ~obs) > 1
        QUALIFY em & ~(obs | s.inf) = t OR row_number() OVER (PARTITION BY s.ds, mask, CASE WHEN em & ~(obs | s.inf) = t THEN s.inf ELSE s.inf | (em & ~(obs | s.inf)) END, em & ~(obs | s.inf) = t ORDER BY s.rank, e.eid) = 1)),
    ch AS (SELECT * FROM st WHERE done)"""


_BUILT: dict[tuple, tuple] = {}


def _once(spark: SparkSession, kind: str, source, make):
    """What ``make`` gives, made once in a session."""
    key = (spark.sparkContext.applicationId, kind, source)
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


def _constraints(spark: SparkSession, source: str | tuple[str, ...]) -> DataFrame:
    """The constraints of some catalogs (their names), or of all five and of the tables in a folder."""
    if not isinstance(source, str):
        return constraints.catalog(spark, source)
    both = lambda: Scratch(spark).put(constraints.catalog(spark).unionByName(weights.kept_weights(mined.weighted(spark, source))), "constraints")
    return _once(spark, "constraints", source, both)


def _model(spark: SparkSession, source: str | tuple[str, ...]) -> tuple[DataFrame, Scratch]:
    """The models of those constraints."""

    def make():
        scratch = Scratch(spark)
        return scratch.put(hypergraph.models(_constraints(spark, source)), "model"), scratch

    return _once(spark, "model", source, make)


# ---- constraints and their graphs ----


@query("""SELECT c_custkey, nullif(trim(c_name), '') AS name, CASE WHEN c_mktsegment IN ('', 'NA', 'None', '#') THEN NULL ELSE lower(replace(c_mktsegment, '-', '_')) END AS segment,
 TRY_CAST(trunc(c_acctbal) AS INTEGER) AS whole_balance, greatest(0.0::DOUBLE, least(1.0::DOUBLE, c_acctbal / 10000.0::DOUBLE)) AS share FROM customer""")
def ingest_clean(spark, sf_dir):
    """Null words, trimming, whole numbers cut towards zero and clipping."""
    from veilgraph.sources.datasets import NULL_WORDS

    c = table(spark, sf_dir, "customer")
    segment = F.when(F.col("c_mktsegment").isin(*NULL_WORDS), None).otherwise(X.plain_name(F.col("c_mktsegment")))
    return c.select("c_custkey", F.nullif(F.trim("c_name"), F.lit("")).alias("name"), segment.alias("segment"), F.col("c_acctbal").cast("string").try_cast("double").cast("int").alias("whole_balance"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c_acctbal") / 10000.0)).alias("share"))


def _preds_rows(parsed: DataFrame, key: str) -> DataFrame:
    """A row for each predicate of (key, preds)."""
    return parsed.select(key, F.posexplode("preds").alias("pos", "p")).select(key, "pos", "p.*")


_PRED_SQL = "t\\d\\.[\\w\\-]+\\s*(==|!=|<>|<=|>=|<|>)\\s*t\\d\\.[\\w\\-]+"


@query(f"""WITH d AS (SELECT o_orderkey, trim({TEXT_LINE}) AS line FROM orders),
 p AS (SELECT o_orderkey, unnest(regexp_extract_all(line, '{_PRED_SQL}')) AS s, generate_subscripts(regexp_extract_all(line, '{_PRED_SQL}'), 1) - 1 AS pos FROM d WHERE line LIKE 'not%')
 SELECT o_orderkey, pos::INTEGER AS pos, (regexp_extract(s, 't(\\d)', 1)::INTEGER - 1) AS i1, regexp_extract(s, 't\\d\\.([\\w\\-]+)', 1) AS c1, replace(regexp_extract(s, '(==|!=|<>|<=|>=|<|>)', 1), '<>', '!=') AS op,
 (regexp_extract(s, '[=<>]\\s*t(\\d)', 1)::INTEGER - 1) AS i2, regexp_extract(s, '[=<>]\\s*t\\d\\.([\\w\\-]+)', 1) AS c2 FROM p""")
def dc_parse_text(spark, sf_dir):
    """Predicates of constraints written as text, a line from each order."""
    lines = table(spark, sf_dir, "orders").select("o_orderkey", F.trim(F.expr(TEXT_LINE)).alias("line")).filter(F.col("line").startswith("not"))
    return _preds_rows(lines.select("o_orderkey", constraints.predicates_of_text(F.col("line")).alias("preds")), "o_orderkey")


@query(f"""WITH l AS (SELECT p_partkey, {JSON_LINE} AS j FROM part), p AS (SELECT p_partkey, j::JSON->'$.predicates[*]' AS a FROM l),
 k AS (SELECT * FROM p WHERE len(a) BETWEEN 1 AND 3 AND len(list_filter(a, lambda x: (x->>'$.index1')::INT NOT IN (0, 1) OR (x->>'$.index2')::INT NOT IN (0, 1))) = 0),
 u AS (SELECT p_partkey, unnest(a) AS x, generate_subscripts(a, 1) - 1 AS pos FROM k)
 SELECT p_partkey, pos::INTEGER AS pos, (x->>'$.index1')::INTEGER AS i1, split_part(x->>'$.column1.columnIdentifier', ' ', 1) AS c1,
 CASE x->>'$.op' WHEN 'EQUAL' THEN '==' WHEN 'UNEQUAL' THEN '!=' WHEN 'LESS' THEN '<' WHEN 'LESS_EQUAL' THEN '<=' WHEN 'GREATER' THEN '>' ELSE '>=' END AS op,
 (x->>'$.index2')::INTEGER AS i2, split_part(x->>'$.column2.columnIdentifier', ' ', 1) AS c2 FROM u""")
def dc_parse_json(spark, sf_dir):
    """Predicates of constraints written as JSON lines, of 1 to 3 predicates, a line from each part."""
    lines = table(spark, sf_dir, "part").select("p_partkey", F.expr(JSON_LINE).alias("line"))
    return _preds_rows(lines.select("p_partkey", constraints.predicates_of_json(F.col("line")).alias("preds")).filter("preds is not null"), "p_partkey")


@query("""SELECT c_custkey, 't0.' || lower(c_mktsegment) || ' == t1.' || lower(c_mktsegment) || CASE WHEN c_custkey % 2 = 0 THEN ' AND t0.area_code != t1.area_code' ELSE '' END AS dc, c_acctbal / 1000.0::DOUBLE AS weight FROM customer WHERE c_acctbal > 0""")
def dc_parse_weighted(spark, sf_dir):
    """Rows of a weight file with a positive weight, and their constraints as text: a row from each customer."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(WEIGHTED_LINE).alias("dc_str"), (F.col("c_acctbal") / 1000.0).alias("weight")).filter("weight > 0")
    return rows.select("c_custkey", constraints.to_text(constraints.predicates_of_weighted(F.col("dc_str"))).alias("dc"), "weight")


@query(f"""WITH {LINES_SQL}, a AS (SELECT *, list_sort(list_distinct(regexp_extract_all(line, 't\\d\\.([\\w\\-]+)', 1))) AS l FROM c)
 SELECT dataset, dc_id, array_to_string(l, ',') AS attrs, weight FROM a WHERE len(l) >= 2""")
def dc_to_edges(spark, sf_dir):
    """The hyperedge of every constraint of all five catalogs."""
    return hypergraph.hyperedges(_constraints(spark, sf_dir)).select("dataset", "dc_id", F.array_join("attrs", ",").alias("attrs"), "weight")


@query(f"""WITH {LINES_SQL}, a AS (SELECT DISTINCT dataset, dc_id, unnest(regexp_extract_all(line, 't1\\.([\\w\\-]+)', 1)) AS attr FROM c)
 SELECT dataset, attr, string_agg('phi' || (dc_id + 1), ',' ORDER BY dc_id) AS labels FROM a GROUP BY ALL""")
def attr_dc_lookup(spark, sf_dir):
    """The constraints that use each attribute."""
    return hypergraph.attribute_constraints(_constraints(spark, sf_dir)).select("dataset", "attr", F.array_join("labels", ",").alias("labels"))


@query(f"""WITH {LINES_SQL}, a AS (SELECT DISTINCT dataset, dc_id, unnest(regexp_extract_all(line, 't1\\.([\\w\\-]+)', 1)) AS attr FROM c),
 v AS (SELECT dataset, count(DISTINCT attr) AS n_attrs FROM a GROUP BY 1), p AS (SELECT dataset, count(*) AS n_pairs FROM (SELECT DISTINCT x.dataset, x.attr, y.attr AS b FROM a x JOIN a y USING (dataset, dc_id) WHERE x.attr < y.attr) GROUP BY 1)
 SELECT dataset, n_attrs, n_pairs, round(n_pairs / n_attrs::DOUBLE, 9) AS rho1 FROM v JOIN p USING (dataset)""")
def rho1(spark, sf_dir):
    """Attribute pairs that share a constraint, over attributes."""
    return hypergraph.density(_constraints(spark, sf_dir)).withColumn("rho1", F.round("rho1", 9))


@query(f"""WITH RECURSIVE {LINES_SQL}, t(dataset, target) AS (VALUES {", ".join(f"('{d}', '{a}')" for d, a in ALL_TARGETS.items())}),
 a AS (SELECT DISTINCT dataset, dc_id, unnest(regexp_extract_all(line, 't\\d\\.([\\w\\-]+)', 1)) AS attr FROM c),
 z AS (SELECT dataset, target AS attr FROM t UNION SELECT y.dataset, y.attr FROM z JOIN a x ON x.dataset = z.dataset AND x.attr = z.attr JOIN a y ON y.dataset = x.dataset AND y.dc_id = x.dc_id)
 SELECT dataset, target, string_agg(attr, ',' ORDER BY attr) AS names, count(*) AS n, (SELECT count(DISTINCT dc_id) FROM a JOIN z USING (dataset, attr) WHERE a.dataset = t.dataset) AS n_edges FROM z JOIN t USING (dataset) WHERE attr != target GROUP BY ALL""")
def zone_closure(spark, sf_dir):
    """The inference zone of each catalog's target, and its edges."""
    z = hypergraph.zones(hypergraph.hyperedges(_constraints(spark, sf_dir)))
    return z.select("dataset", "target", F.array_join("names", ",").alias("names"), F.size("names").cast("long").alias("n"), F.size("edges").cast("long").alias("n_edges"))


@query(f"""WITH RECURSIVE {MODEL_SQL}, {MASKS_SQL} SELECT ds AS dataset, mask, eid, bit_count(em & (mask | t)) < 2 AS unblocked, (em & t != 0 AND em & mask = 0) AS infers_target FROM mk JOIN e USING (ds)""")
def edge_active(spark, sf_dir):
    """Which edges deletion blocks, and which infer the target from what is left, for all masks of the five catalogs and the tables."""
    model, _ = _model(spark, sf_dir)
    rows = leakage.powerset(model).select("dataset", "mask", "tbit", F.explode("edges").alias("e"))
    known = F.bitwise_not(F.col("mask").bitwiseOR(F.col("tbit")))
    return rows.select("dataset", "mask", "e.eid", hypergraph.unblocked(F.col("e.mask"), F.col("mask"), F.col("tbit")).alias("unblocked"), hypergraph.active(F.col("e.mask"), F.col("tbit"), known).alias("infers_target"))


@query(f"""WITH {LINES_SQL} SELECT dataset, dc_id, weight FROM c WHERE weight <= 0.25::DOUBLE""")
def tau_filter(spark, sf_dir):
    """Edges that weigh at most tau."""
    return hypergraph.hyperedges(_constraints(spark, sf_dir)).filter(F.col("weight") <= 0.25).select("dataset", "dc_id", "weight")


# ---- pairs and weights ----


@query("SELECT a.o_orderkey AS l_key, b.o_orderkey AS r_key FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderstatus != b.o_orderstatus AND a.o_orderkey != b.o_orderkey")
def dc_violations_equi(spark, sf_dir):
    """Pairs that violate a constraint with an equality: a hash or sort-merge join."""
    return pairs.violations(table(spark, sf_dir, "orders"), "o_orderkey", ORDER_DCS[0])


@query("SELECT a.s_suppkey AS l_key, b.s_suppkey AS r_key FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal AND a.s_nationkey > b.s_nationkey AND a.s_suppkey != b.s_suppkey")
def dc_violations_theta(spark, sf_dir):
    """Pairs that violate a constraint of inequalities, over few rows."""
    return pairs.violations(table(spark, sf_dir, "supplier"), "s_suppkey", [(0, "s_acctbal", "<", 1, "s_acctbal"), (0, "s_nationkey", ">", 1, "s_nationkey")])


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def _hash_sql(*parts: str) -> str:
    return "('0x' || substr(md5(" + " || '|' || ".join(parts) + "), 1, 8))::BIGINT"


PAIRS_SQL = f"""o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, * FROM orders), k AS (SELECT count(*) AS n FROM orders),
 s AS (SELECT pair, {_hash_sql("'7'", "'l'", "pair::VARCHAR")} % n AS i, {_hash_sql("'7'", "'r'", "pair::VARCHAR")} % (n - 1) + 1 AS st, n FROM (SELECT unnest(range(0, {PAIRS})) AS pair), k),
 pr AS (SELECT pair, x.o_orderkey AS lk, y.o_orderkey AS rk, x.o_custkey AS lc, y.o_custkey AS rc, x.o_orderstatus AS ls, y.o_orderstatus AS rs, x.o_totalprice AS lt, y.o_totalprice AS rt, x.o_orderpriority AS lp, y.o_orderpriority AS rp
  FROM s JOIN o x ON x.rn = s.i JOIN o y ON y.rn = (s.i + s.st) % s.n)"""
#: The same constraints' predicates in SQL, over the columns of PAIRS_SQL.
ORDER_SQL = [["lc = rc", "ls != rs"], ["ls = rs", "lt < rt", "lk > rk"], ["lp != rp", "lc <= rc"], ["ls = rs", "lp = rp", "lt >= rt"]]


def _counts_sql() -> str:
    parts = []
    for d, dc in enumerate(ORDER_SQL):
        for j, head in enumerate(dc):
            premise = " AND ".join(p for i, p in enumerate(dc) if i != j) or "true"
            parts.append(f"SELECT {d + 1} AS dc_id, {len(dc)} AS m, {j} AS head_j, count(*) AS nV, count(*) FILTER (NOT ({head})) AS k0, count(*) FILTER ({premise}) AS nE, count(*) FILTER ({premise} AND NOT ({head})) AS k1 FROM pr")
    return "ct AS (" + " UNION ALL ".join(parts) + ")"


def _wilson_sql(k: str, n: str, sign: str) -> str:
    z = X.Z_VALUES[0.90]
    centre = f"(({k}::DOUBLE / {n} + {z * z!r}::DOUBLE / (2 * {n})) / (1 + {z * z!r}::DOUBLE / {n}))"
    radius = f"({z!r}::DOUBLE * sqrt(({k}::DOUBLE / {n} * (1 - {k}::DOUBLE / {n}) + {z * z!r}::DOUBLE / (4 * {n})) / {n}) / (1 + {z * z!r}::DOUBLE / {n}))"
    if sign == "-":
        return f"CASE WHEN {n} <= 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, {centre} - {radius}) END"
    return f"CASE WHEN {n} <= 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, {centre} + {radius}) END"


STATS_SQL = f"""{PAIRS_SQL}, {_counts_sql()}, bd AS (SELECT *, {_wilson_sql("k0", "nV", "+")} AS u, {_wilson_sql("k1", "nE", "-")} AS l FROM ct),
 ds AS (SELECT *, nV >= 200 AND 1 - u > 1e-12 AND nE > 0 AS tells FROM bd),
 dr AS (SELECT dc_id, m, head_j, nV, k0, k1, CASE WHEN tells THEN nE ELSE 0 END AS nE, CASE WHEN nV >= 200 THEN u END AS UCB0, CASE WHEN tells THEN l END AS LCB1, CASE WHEN tells THEN (l - u) / (1 - u) ELSE 0.0::DOUBLE END AS base FROM ds),
 be AS (SELECT dc_id, m, nV, CASE WHEN nE >= 50 THEN head_j ELSE -1 END AS best_head_j, CASE WHEN nE >= 50 THEN nE ELSE 0 END AS nE_best, CASE WHEN nE >= 50 THEN greatest(base, 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS best_base
  FROM dr QUALIFY row_number() OVER (PARTITION BY dc_id ORDER BY (nE >= 50)::INT DESC, CASE WHEN nE >= 50 THEN base END DESC NULLS LAST, head_j) = 1)"""


@query(f"WITH {PAIRS_SQL} SELECT pair, lk AS l_key, rk AS r_key FROM pr")
def pair_sample(spark, sf_dir):
    """A repeatable uniform sample of ordered pairs of different orders."""
    return _sample(spark, sf_dir).select("pair", F.col("l_o_orderkey").alias("l_key"), F.col("r_o_orderkey").alias("r_key"))


def _sample(spark, sf_dir):
    """The sample of order pairs, drawn once in a session."""
    return _once(spark, "pairs", sf_dir, lambda: Scratch(spark).put(pairs.sample_pairs(_orders(spark, sf_dir), "o_orderkey", PAIRS), "pairs"))


def _stats(spark, sf_dir):
    return weights.direction_stats(weights.direction_counts(_sample(spark, sf_dir), ORDER_DCS))


def _best(spark, sf_dir):
    return weights.best_heads(_stats(spark, sf_dir), 50)


@query(f"WITH {STATS_SQL} SELECT dc_id, m, head_j, nV, k0, k1, nE, round(UCB0, 9) AS UCB0, round(LCB1, 9) AS LCB1, round(base, 9) AS base FROM dr")
def dc_direction_stats(spark, sf_dir):
    """Counts, Wilson bounds and base of each constraint and head, from one pass over the pairs."""
    s = _stats(spark, sf_dir)
    return s.withColumns({c: F.round(c, 9) for c in ("UCB0", "LCB1", "base")})


@query(f"WITH {STATS_SQL} SELECT dc_id, m, nV, best_head_j, nE_best, round(best_base, 9) AS best_base FROM be")
def dc_best_head(spark, sf_dir):
    """The best head of each constraint."""
    return _best(spark, sf_dir).select("dc_id", "m", "nV", "best_head_j", "nE_best", F.round("best_base", 9).alias("best_base"))


@query(f"WITH {STATS_SQL} SELECT dc_id, g AS gamma, replace(printf('%.2f', g), '.', 'p') AS tag, round(greatest(0.0::DOUBLE, best_base - g), 9) AS weight FROM be, (VALUES (0.25::DOUBLE), (0.5::DOUBLE)) v(g)")
def dc_weights_gamma(spark, sf_dir):
    """Weights above each threshold."""
    return weights.with_gammas(_best(spark, sf_dir)).select("dc_id", "gamma", X.gamma_tag(F.col("gamma")).alias("tag"), F.round("weight", 9).alias("weight"))


@query(f"WITH {STATS_SQL} SELECT g AS gamma, count(*) AS n_dcs, count(*) FILTER (best_base - g > 0) AS n_kept FROM be, (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.15::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE)) v(g) GROUP BY g")
def gamma_sweep(spark, sf_dir):
    """How many constraints keep a weight at each threshold."""
    return weights.gamma_sweep(_best(spark, sf_dir))


@query(f"WITH {LINES_SQL} SELECT dataset, count(*) AS n_dcs, count(*) FILTER (weight > 0.25) AS n_heavy, round(avg(weight), 9) AS mean_weight FROM c WHERE weight > 0 GROUP BY dataset")
def dc_kept_summary(spark, sf_dir):
    """Kept constraints of each catalog."""
    return weights.kept_weights(_constraints(spark, sf_dir)).groupBy("dataset").agg(F.count(F.lit(1)).alias("n_dcs"), F.count_if(F.col("weight") > 0.25).alias("n_heavy"), F.round(F.avg("weight"), 9).alias("mean_weight"))


# ---- other dependency weights ----


@query("""WITH x AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL), y AS (SELECT l_partkey, sum(n) AS n, max(n) AS top FROM x GROUP BY 1)
 SELECT 'l_partkey' AS lhs, 'l_suppkey' AS rhs, sum(n)::BIGINT AS n, sum(n - top)::BIGINT AS errors, round(sum(n - top) / sum(n)::DOUBLE, 9) AS g3, round(1 - sum(n - top) / sum(n)::DOUBLE, 9) AS weight, sum(n - top) / sum(n)::DOUBLE <= 0.05 AS valid FROM y""")
def afd_g3(spark, sf_dir):
    """The g3 error of part determining supplier."""
    out = dependencies.g3_error(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_suppkey")
    return out.withColumns({c: F.round(c, 9) for c in ("g3", "weight")})


def _discover_sql() -> str:
    parts = []
    for lhs in (["l_returnflag"], ["l_linestatus"], ["l_linenumber"], ["l_returnflag", "l_linestatus"], ["l_returnflag", "l_linenumber"], ["l_linestatus", "l_linenumber"]):
        cols, label = ", ".join(lhs), ",".join(sorted(lhs))
        parts.append(f"SELECT '{label}' AS lhs, sum(n)::BIGINT AS n, sum(n - top)::BIGINT AS errors FROM (SELECT {cols}, sum(n) AS n, max(n) AS top FROM (SELECT {cols}, l_discount, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY {cols})")
    return "SELECT lhs, n, errors, round(errors / n::DOUBLE, 9) AS g3, errors / n::DOUBLE <= 0.05 AS valid FROM (" + " UNION ALL ".join(parts) + ")"


@query(_discover_sql())
def afd_discovery(spark, sf_dir):
    """g3 of all sets of one or two columns towards the discount, from one scan with grouping sets."""
    out = dependencies.discover(table(spark, sf_dir, "lineitem"), ["l_linenumber", "l_linestatus", "l_returnflag"], "l_discount")
    return out.select("lhs", "n", "errors", F.round("g3", 9).alias("g3"), "valid")


@query("""WITH x AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY ALL), y AS (SELECT l_returnflag, sum(n) AS n, max(n) AS top FROM x GROUP BY 1)
 SELECT round(sum(top) / sum(n)::DOUBLE, 9) AS avg_prob, round(min(top / n::DOUBLE), 9) AS worst_prob, count(*) AS n_contexts FROM y""")
def cond_prob(spark, sf_dir):
    """The commonest status' share within each flag."""
    out = dependencies.conditional_probability(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linestatus")
    return out.withColumns({c: F.round(c, 9) for c in ("avg_prob", "worst_prob")})


@query("SELECT round(avg((l_quantity > 10 AND l_discount < 0.08)::INT), 9) AS confidence FROM lineitem")
def dc_confidence(spark, sf_dir):
    """The share of line items that fulfil a predicate."""
    return dependencies.confidence(table(spark, sf_dir, "lineitem"), (F.col("l_quantity") > 10) & (F.col("l_discount") < 0.08)).withColumn("confidence", F.round("confidence", 9))


@query("""WITH x AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT sum(n)::DOUBLE AS t FROM x),
 h AS (SELECT -sum(n / t * ln(n / t)) AS h FROM (SELECT l_linestatus, sum(n) AS n FROM x GROUP BY 1), t), g AS (SELECT -sum(x.n / t * ln(x.n / y.n::DOUBLE)) AS g FROM x JOIN (SELECT l_returnflag, sum(n) AS n FROM x GROUP BY 1) y USING (l_returnflag), t)
 SELECT round(h, 6) AS h_rhs, round(g, 6) AS h_given, round(greatest(0.0::DOUBLE, 1 - g / h), 6) AS gain FROM h, g""")
def info_gain(spark, sf_dir):
    """What a flag tells about the status."""
    return dependencies.information_gain(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linestatus").select(*[F.round(c, 6).alias(c) for c in ("h_rhs", "h_given", "gain")])


DD_SQL = f"""p AS (SELECT * FROM part ORDER BY md5(p_partkey::VARCHAR), p_partkey LIMIT {SAMPLE}),
 q AS (SELECT x.p_partkey AS a, y.p_partkey AS b, x.p_size AS xs, y.p_size AS ys, x.p_retailprice AS xp, y.p_retailprice AS yp, x.p_brand AS xb, y.p_brand AS yb FROM p x JOIN p y ON x.p_partkey < y.p_partkey)"""


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand")


@query(f"WITH {DD_SQL} SELECT a AS l_key, b AS r_key, round(sqrt((xs - ys) * (xs - ys)::DOUBLE + CASE WHEN xb = yb THEN 0 ELSE 1 END), 9) AS d FROM q")
def dd_distance(spark, sf_dir):
    """Distances over a number and a text, of all pairs of a bounded sample."""
    some = dependencies.sample_distances(_parts(spark, sf_dir).withColumn("key", F.col("p_partkey")), "p_partkey", ["key", "p_size", "p_brand"], SAMPLE)
    d = dependencies.distance(some, ["p_size", "p_brand"])
    return some.select(F.col("l_key"), F.col("r_key"), F.round(d, 9).alias("d"))


@query(f"WITH {DD_SQL} SELECT round((quantile_cont(abs(xs - ys)::DOUBLE, 0.25) + quantile_cont(abs(xp - yp), 0.25)) / 2, 6) AS theta FROM q")
def dd_threshold(spark, sf_dir):
    """The mean first quartile of two columns' distances."""
    return dependencies.threshold(_parts(spark, sf_dir), "p_partkey", ["p_size", "p_retailprice"], SAMPLE).select(F.round("theta", 6).alias("theta"))


@query(f"WITH {DD_SQL}, s AS (SELECT count(*) FILTER (abs(xs - ys) <= 5) AS n_close, count(*) FILTER (abs(xs - ys) <= 5 AND abs(xp - yp) <= 100) AS n_both FROM q) SELECT n_close, n_both, round(n_both / n_close::DOUBLE, 9) AS support, n_both / n_close::DOUBLE >= 0.9 AS valid FROM s")
def dd_support(spark, sf_dir):
    """How often parts close in size are close in price."""
    some = dependencies.sample_distances(_parts(spark, sf_dir), "p_partkey", ["p_size", "p_retailprice"], SAMPLE)
    return dependencies.differential_support(some, ["p_size"], ["p_retailprice"], 5.0, 100.0).withColumn("support", F.round("support", 9))


# ---- leakage and masks ----


@query(f"WITH RECURSIVE {MODEL_SQL}, {MASKS_SQL} SELECT ds AS dataset, mask, bit_count(mask)::INTEGER AS mask_size FROM mk")
def powerset(spark, sf_dir):
    """All 13384 masks of the five catalogs."""
    return leakage.powerset(_model(spark, sf_dir)[0]).select("dataset", "mask", "mask_size")


@query(f"""WITH RECURSIVE {MODEL_SQL}, {MASKS_SQL}, d AS (SELECT k.ds, mask, w FROM mk k JOIN e ON e.ds = k.ds AND em & t != 0 AND em & mask = 0)
 SELECT k.ds AS dataset, k.mask, count(d.w)::INTEGER AS direct_chains, round(coalesce(1 - product(1 - d.w), 0.0::DOUBLE), 9) AS leakage_direct, round(coalesce(max(d.w), 0.0::DOUBLE), 9) AS leakage_max FROM mk k LEFT JOIN d ON d.ds = k.ds AND d.mask = k.mask GROUP BY k.ds, k.mask""")
def leak_direct(spark, sf_dir):
    """Leakage over single edges, and its maximum, for all masks."""
    out = leakage.direct_leakage(leakage.powerset(_model(spark, sf_dir)[0]))
    return out.select("dataset", "mask", "direct_chains", F.round("leakage_direct", 9).alias("leakage_direct"), F.round("leakage_max", 9).alias("leakage_max"))


def _leakage(spark: SparkSession, source: str | tuple[str, ...]):
    """A model with its leakage table, built once in a session: it depends on no budget, cap or penalty."""

    def make():
        model, scratch = _model(spark, source)
        return model, scratch, leakage.leakage_table(model, scratch)

    return _once(spark, "leakage", source, make)


GREEDY_SQL = """gr AS (SELECT ds, mask, count(*) AS num, count(*) FILTER (lvl = 0) AS act, max(w) FILTER (lvl = 0) AS mx, 1 - product(1 - w) AS nor,
  1 - list_reduce(list(struct_pack(used := inf::BIGINT, lft := w) ORDER BY -w, bit_count(inf), lvl, rank, eid, inf), lambda s, c: CASE WHEN s.used & c.used = 0 THEN struct_pack(used := s.used | c.used, lft := s.lft * (1 - c.lft)) ELSE s END, struct_pack(used := 0::BIGINT, lft := 1.0::DOUBLE)).lft AS gre
  FROM ch GROUP BY ds, mask),
 lk AS (SELECT k.ds, k.n, k.t, k.mask, bit_count(k.mask)::INTEGER AS sz, coalesce(num, 0) AS num, coalesce(act, 0) AS act, coalesce(mx, 0.0::DOUBLE) AS mx, coalesce(nor, 0.0::DOUBLE) AS nor, coalesce(gre, 0.0::DOUBLE) AS gre FROM mk k LEFT JOIN gr ON gr.ds = k.ds AND gr.mask = k.mask)"""
LEAK_SQL = f"WITH {_chains_sql()}, {GREEDY_SQL}"


@query(f"{LEAK_SQL} SELECT ds AS dataset, mask, num AS num_chains, act AS active_chains, num - act AS blocked_chains FROM lk")
def chain_counts(spark, sf_dir):
    """Chains of every mask of the five catalogs."""
    return _leakage(spark, sf_dir)[2].select("dataset", "mask", "num_chains", "active_chains", "blocked_chains")


@query(f"{LEAK_SQL} SELECT ds AS dataset, mask, round(gre, 9) AS leakage FROM lk")
def leak_greedy(spark, sf_dir):
    """Leakage over a greedy set of chains that infer different cells."""
    return _leakage(spark, sf_dir)[2].select("dataset", "mask", F.round("leakage_greedy", 9).alias("leakage"))


@query(f"{LEAK_SQL} SELECT ds AS dataset, mask, round(nor, 9) AS leakage FROM lk")
def leak_noisy_or(spark, sf_dir):
    """Leakage over all chains."""
    return _leakage(spark, sf_dir)[2].select("dataset", "mask", F.round("leakage_noisy_or", 9).alias("leakage"))


@query(f"{LEAK_SQL} SELECT ds AS dataset, mask, round(mx, 9) AS leakage FROM lk")
def leak_max(spark, sf_dir):
    """The weight of the best unblocked chain."""
    return _leakage(spark, sf_dir)[2].select("dataset", "mask", F.round("leakage_max", 9).alias("leakage"))


@query()
def leak_ie2(spark, sf_dir):
    """The second-order bound of every mask of the five catalogs."""
    return leakage.leakage_table(_model(spark, sf_dir)[0], Scratch(spark), method="nor_with_ie").select("dataset", "mask", F.round("leakage_ie", 9).alias("leakage"))


def _names_sql(mask: str, ds: str) -> str:
    return f"coalesce((SELECT string_agg(nm.name, '|' ORDER BY nm.pos) FROM nm WHERE nm.ds = {ds} AND {mask} & nm.bit != 0), '')"


@query(f"""{LEAK_SQL} SELECT ds AS dataset, {_names_sql("lk.mask", "lk.ds")} AS mask_names, sz AS mask_size, round(nor, 9) AS leakage_noisy_or, round(gre, 9) AS leakage_greedy, round(mx, 9) AS leakage_max,
 -sz::DOUBLE - CASE WHEN round(gre, 9) > 0.2 THEN 1000.0::DOUBLE ELSE 0.0::DOUBLE END AS utility_greedy, mx <= gre + 1e-9 AND gre <= nor + 1e-9 AS bounds_ok FROM lk""")
def all_masks(spark, sf_dir):
    """Every mask by name with three estimators, and whether they are in order."""
    model, _, t = _leakage(spark, sf_dir)
    out = leakage.all_masks(t, model)
    return out.select("dataset", "mask_names", "mask_size", *[F.round(c, 9).alias(c) for c in ("leakage_noisy_or", "leakage_greedy", "leakage_max")], "utility_greedy", "bounds_ok")


@query()
def all_masks_five(spark, sf_dir):
    """The same for all five catalogs."""
    model, _, t = _leakage(spark, sf_dir)
    return leakage.all_masks(t, model)


# ---- mechanisms ----

POINTS = ((0.1, 0.2), (0.5, 0.4), (1.0, 0.3))
POINTS_SQL = "pt(eps, cap) AS (VALUES " + ", ".join(f"({e!r}::DOUBLE, {c!r}::DOUBLE)" for e, c in POINTS) + ")"
EM_SQL = f"""{LEAK_SQL}, {POINTS_SQL}, sc AS (SELECT ds, n, mask, sz, gre, eps, cap, -sz::DOUBLE - CASE WHEN gre > cap THEN 1000.0::DOUBLE ELSE 0.0::DOUBLE END AS u FROM lk, pt),
 ex AS (SELECT *, exp(eps * u * n / 2 - max(eps * u * n / 2) OVER (PARTITION BY ds, eps, cap)) AS x FROM sc), em AS (SELECT *, x / sum(x) OVER (PARTITION BY ds, eps, cap) AS p FROM ex)"""


def _at(spark):
    return spark.createDataFrame(list(POINTS), "epsilon double, cap double")


def _em(spark, sf_dir):
    model, _, t = _leakage(spark, sf_dir)
    return mechanisms.probabilities(mechanisms.all_mask_candidates(t, model), _at(spark))


@query(f"{EM_SQL} SELECT ds AS dataset, mask, eps AS epsilon, cap, u AS utility, round(p, 9) AS p FROM em")
def em_probabilities(spark, sf_dir):
    """The exponential mechanism over all masks at three points."""
    return _em(spark, sf_dir).select("dataset", "mask", "epsilon", "cap", "utility", F.round("p", 9).alias("p"))


@query(f"{EM_SQL} SELECT ds AS dataset, eps AS epsilon, cap, round(sum(p * sz), 6) AS e_mask, round(sum(p * gre), 6) AS e_leakage FROM em GROUP BY ALL")
def em_expected(spark, sf_dir):
    """Expected mask size and leakage."""
    return mechanisms.expected(_em(spark, sf_dir)).select("dataset", "epsilon", "cap", F.round("e_mask", 6).alias("e_mask"), F.round("e_leakage", 6).alias("e_leakage"))


TARGET_SQL = "CASE ds " + " ".join(f"WHEN '{d}' THEN '{t}'" for d, t in ALL_TARGETS.items()) + " END"


@query(f"""{EM_SQL}, cd AS (SELECT *, sum(p) OVER (PARTITION BY ds, eps, cap ORDER BY sz, mask ROWS UNBOUNDED PRECEDING) AS hi FROM em),
 dw AS (SELECT ds, eps, cap, it, ({_hash_sql("'7'", "ds", TARGET_SQL, "eps::VARCHAR", "cap::VARCHAR", "it::VARCHAR")} + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM (SELECT DISTINCT ds, eps, cap FROM em), (SELECT unnest(range(0, 50)) AS it))
 SELECT dw.ds AS dataset, dw.eps AS epsilon, dw.cap, it::INTEGER AS iteration, arg_min(cd.mask, (cd.hi, cd.sz, cd.mask)) AS mask FROM dw JOIN cd ON cd.ds = dw.ds AND cd.eps = dw.eps AND cd.cap = dw.cap AND cd.p > 1e-15 AND cd.hi >= dw.u GROUP BY ALL""")
def em_sample(spark, sf_dir):
    """50 repeatable draws at each point."""
    return mechanisms.draw(_em(spark, sf_dir), 50, seed=7).select("dataset", "epsilon", "cap", "iteration", "mask")


def _bits_sql(order: str) -> str:
    return f"""od AS (SELECT nm.ds, nm.name, nm.bit, a.gre - b.gre AS gain, row_number() OVER (PARTITION BY nm.ds ORDER BY {order}) AS step FROM nm JOIN lk a ON a.ds = nm.ds AND a.mask = 0 JOIN lk b ON b.ds = nm.ds AND b.mask = nm.bit),
 pf AS (SELECT ds, step, sum(bit) OVER (PARTITION BY ds ORDER BY step)::BIGINT AS mask FROM od UNION ALL SELECT ds, 0, 0 FROM m)"""


GREEDY_ORDER = "round(a.gre - b.gre, 12) DESC, nm.name"


@query(f"{LEAK_SQL}, {_bits_sql(GREEDY_ORDER)} SELECT ds AS dataset, name, step::INTEGER AS step, round(gain, 9) AS gain FROM od")
def gum_order(spark, sf_dir):
    """Cells by how much deleting each alone lowers leakage."""
    model, _, t = _leakage(spark, sf_dir)
    rows = t.select("dataset", "target", "mask", F.round("leakage_greedy", 15).alias("leakage"))
    prefixes = mechanisms.prefix_masks(model, rows.filter(F.bit_count("mask") <= 1))
    from pyspark.sql import Window

    order = Window.partitionBy("dataset").orderBy("step")
    bits = prefixes.withColumn("bit", F.col("mask") - F.lag("mask").over(order)).filter("step > 0")
    base = rows.filter("mask = 0").select("dataset", F.col("leakage").alias("l0"))
    single = rows.select("dataset", F.col("mask").alias("bit"), F.col("leakage").alias("l1"))
    names = model.select("dataset", F.posexplode("names").alias("pos", "name")).withColumn("bit", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos")))
    return bits.join(base, "dataset").join(single, ["dataset", "bit"]).join(names, ["dataset", "bit"]).select("dataset", "name", "step", F.round(F.col("l0") - F.col("l1"), 9).alias("gain"))


def _gum(spark, sf_dir, ordering="greedy"):
    model, scratch, t = _leakage(spark, sf_dir)
    return mechanisms.prefix_candidates(model, scratch, t, ordering)


@query(f"{LEAK_SQL}, {_bits_sql(GREEDY_ORDER)} SELECT pf.ds AS dataset, step::INTEGER AS step, mask, round(gre, 9) AS leakage FROM pf JOIN lk USING (ds, mask)")
def gum_prefixes(spark, sf_dir):
    """The prefixes of that order, with their leakage."""
    return _gum(spark, sf_dir).select("dataset", "step", "mask", F.round("leakage", 9).alias("leakage"))


GUM_SQL = f"""gp AS (SELECT pf.ds, lk.n, step, mask, sz, gre, eps, cap, -sz::DOUBLE - CASE WHEN gre > cap THEN 1000.0::DOUBLE ELSE 0.0::DOUBLE END AS u FROM pf JOIN lk USING (ds, mask), pt),
 gx AS (SELECT *, exp(eps * u * n / 2 - max(eps * u * n / 2) OVER (PARTITION BY ds, eps, cap)) AS x FROM gp), gq AS (SELECT *, x / sum(x) OVER (PARTITION BY ds, eps, cap) AS p FROM gx)"""


@query(f"{LEAK_SQL}, {_bits_sql(GREEDY_ORDER)}, {POINTS_SQL}, {GUM_SQL} SELECT ds AS dataset, eps AS epsilon, cap, mask, round(p, 9) AS p FROM gq")
def gum_probabilities(spark, sf_dir):
    """The exponential mechanism over the prefixes."""
    return mechanisms.probabilities(_gum(spark, sf_dir), _at(spark)).select("dataset", "epsilon", "cap", "mask", F.round("p", 9).alias("p"))


@query(f"{LEAK_SQL}, {_bits_sql('nm.pos')}, {POINTS_SQL}, {GUM_SQL} SELECT ds AS dataset, eps AS epsilon, cap, round(sum(p * sz), 6) AS e_mask, round(sum(p * gre), 6) AS e_leakage FROM gq GROUP BY ALL")
def gum_ablation_zero(spark, sf_dir):
    """What the order by name gives on average."""
    out = mechanisms.expected(mechanisms.probabilities(_gum(spark, sf_dir, "zero"), _at(spark)))
    return out.select("dataset", "epsilon", "cap", F.round("e_mask", 6).alias("e_mask"), F.round("e_leakage", 6).alias("e_leakage"))


_RANDOM_ORDER = f"{_hash_sql(chr(39) + '7' + chr(39), 'nm.name')}, nm.name"


@query(f"{LEAK_SQL}, {_bits_sql(_RANDOM_ORDER)}, {POINTS_SQL}, {GUM_SQL} SELECT ds AS dataset, eps AS epsilon, cap, round(sum(p * sz), 6) AS e_mask, round(sum(p * gre), 6) AS e_leakage FROM gq GROUP BY ALL")
def gum_ablation_random(spark, sf_dir):
    """What a random order gives on average."""
    out = mechanisms.expected(mechanisms.probabilities(_gum(spark, sf_dir, "random"), _at(spark)))
    return out.select("dataset", "epsilon", "cap", F.round("e_mask", 6).alias("e_mask"), F.round("e_leakage", 6).alias("e_leakage"))


CLOSE_SQL = f"""{MODEL_SQL}, {MASKS_SQL}, cl(ds, mask, n, t, k, i) AS (SELECT ds, mask, n, t, ~mask & (t - 1), 0 FROM mk
  UNION ALL SELECT ds, mask, n, t, k | coalesce((SELECT bit_or(em) FROM e WHERE e.ds = cl.ds AND bit_count(em & ~cl.k) = 1), 0), i + 1 FROM cl WHERE i <= n),
 sf AS (SELECT ds, n, mask, bit_count(mask)::INTEGER AS sz FROM cl WHERE i = n + 1 AND k & t = 0)"""


@query(f"WITH RECURSIVE {CLOSE_SQL} SELECT ds AS dataset, n AS zone_size, min(sz) AS mask_size, count(*) FILTER (sz = (SELECT min(sz) FROM sf y WHERE y.ds = sf.ds)) AS n_optima FROM sf GROUP BY ds, n")
def min_deletion(spark, sf_dir):
    """The smallest safe mask of each catalog, and how many there are."""
    return mechanisms.minimal_masks(_model(spark, sf_dir)[0]).select("dataset", F.col("n").alias("zone_size"), "mask_size", "n_optima")


@query(f"""WITH RECURSIVE {MODEL_SQL} SELECT m.ds AS dataset, (10 + n + sum(bit_count(u.em)))::BIGINT AS n_lines, sum(bit_count(u.em))::BIGINT AS n_closure FROM m JOIN (SELECT DISTINCT ds, em FROM e) u ON u.ds = m.ds GROUP BY m.ds, n""")
def lp_program(spark, sf_dir):
    """Lines of the integer program of each catalog."""
    lines = mechanisms.program_lines(_model(spark, sf_dir)[0])
    return lines.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("line").startswith(" closure_")).alias("n_closure"))


# ---- deletion ----


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS c_name, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer""")
def mask_to_null(spark, sf_dir):
    """Requested cells set to null; several requests for a key add up."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    ask = c.filter("c_custkey % 7 = 0").select("c_custkey", F.array(F.lit("C_NAME"), F.lit("c_acctbal"), F.lit("unknown")).alias("names"))
    more = c.filter("c_custkey % 11 = 0").select("c_custkey", F.array(F.lit("c_nationkey"), F.lit("c_acctbal")).alias("names"))
    return deletion.mask_to_null(c, ask.union(more), "c_custkey")


#: b.late: the bits of the cells that are at least as new as the target, for the times of ``_times``.
LATE_SQL = f"""{MODEL_SQL}, k AS (SELECT c_custkey AS key, c_custkey % 5 AS tt, ds, n, t FROM customer, m), b AS (SELECT key, k.ds, n, t + coalesce(sum(nm.bit) FILTER (key % (pos + 2) >= tt), 0)::BIGINT AS late FROM k LEFT JOIN nm ON nm.ds = k.ds GROUP BY key, k.ds, n, t),
 lt AS (SELECT b.key, b.ds, b.n, e.eid, em & late AS em FROM b JOIN e ON e.ds = b.ds WHERE bit_count(em & late) > 1)"""


def _times(spark, sf_dir, model):
    """(dataset, key, times): for each customer and catalog attribute i's time, key % (i + 2), and the target's, key % 5."""
    keys = dealt(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))).join(F.broadcast(model.select("dataset", "target", "names")))
    own = F.map_from_arrays(F.concat("names", F.array("target")), F.concat(F.transform("names", lambda _, i: F.col("key") % (i + 2)), F.array(F.col("key") % 5)))
    return keys.select("dataset", "key", own.alias("times"))


@query(f"""WITH RECURSIVE {LATE_SQL} SELECT b.ds AS dataset, b.key, count(lt.eid) AS n_edges, coalesce(sum(bit_count(lt.em)), 0)::BIGINT AS n_members FROM b LEFT JOIN lt ON lt.key = b.key AND lt.ds = b.ds GROUP BY ALL""")
def insertion_time_filter(spark, sf_dir):
    """Edges left when members older than the target don't count, for every customer and catalog."""
    model, _ = _model(spark, sf_dir)
    late = hypergraph.late_members(model, _times(spark, sf_dir, model))
    out = hypergraph.late_models(model, late).select("dataset", "late", F.size("edges").cast("long").alias("n_edges"), F.aggregate("edges", F.lit(0).cast("long"), lambda s, e: s + F.bit_count(e["mask"])).alias("n_members"))
    return late.join(out, ["dataset", "late"]).select("dataset", "key", "n_edges", "n_members")


@query(f"""WITH RECURSIVE {LATE_SQL}, st AS (SELECT ds, late, list_sort(list_distinct(list(em & late))) AS ed FROM (SELECT DISTINCT ds, late FROM b) JOIN e USING (ds) WHERE bit_count(em & late) > 1 GROUP BY ALL),
 md AS (SELECT row_number() OVER () AS g, ds, n, t, ed FROM (SELECT DISTINCT st.ds, m.n, m.t, ed FROM st JOIN m ON m.ds = st.ds)),
 cl(g, n, t, ed, mask, k, i) AS (SELECT g, n, t, ed, mask, ~mask & (t - 1), 0 FROM (SELECT *, unnest(range(0, t))::BIGINT AS mask FROM md)
  UNION ALL SELECT g, n, t, ed, mask, list_reduce(ed, lambda s, x: CASE WHEN bit_count(x & ~s) = 1 THEN s | x ELSE s END, k), i + 1 FROM cl WHERE i <= n),
 sf AS (SELECT g, bit_count(mask)::INTEGER AS sz FROM cl WHERE i = n + 1 AND k & t = 0),
 bs AS (SELECT g, min(sz) AS mask_size, count(*) FILTER (sz = (SELECT min(sz) FROM sf y WHERE y.g = sf.g)) AS n_optima FROM sf GROUP BY g)
 SELECT b.ds AS dataset, b.key, coalesce(mask_size, 0)::INTEGER AS mask_size, coalesce(n_optima, 1) AS n_optima FROM b LEFT JOIN st ON st.ds = b.ds AND st.late = b.late LEFT JOIN md ON md.ds = st.ds AND md.ed = st.ed LEFT JOIN bs USING (g)""")
def min_deletion_by_time(spark, sf_dir):
    """The smallest safe mask of each customer's row, given its cells' insertion times, for the five catalogs."""
    model, _ = _model(spark, sf_dir)
    late = Scratch(spark).put(hypergraph.late_members(model, _times(spark, sf_dir, model)), "late")
    best = mechanisms.minimal_masks(hypergraph.late_models(model, late)).select("dataset", "late", "mask_size", "n_optima")
    return late.join(best, ["dataset", "late"]).select("dataset", "key", "mask_size", "n_optima")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(o_orderkey::VARCHAR || '|' || '42'), o_orderkey LIMIT 1")
def random_request(spark, sf_dir):
    """A repeatable random row."""
    return deletion.random_key(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 42)


# ---- reports over run records; the records come from orders, so both engines have the same ----

RUNS_SQL = """r AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'exp' ELSE 'gum' END AS method, CASE (o_orderkey // 2) % 5 WHEN 0 THEN 'airport' WHEN 1 THEN 'hospital' WHEN 2 THEN 'adult' WHEN 3 THEN 'flight' ELSE 'tax' END AS dataset,
  (1 + o_custkey % 10) / 10.0::DOUBLE AS epsilon_m, (o_orderkey % 11) / 10.0::DOUBLE AS L0, ((o_orderkey * 7919) % 1000) / 1000.0::DOUBLE AS leakage, (o_custkey % 7)::INTEGER AS mask_size, 12 AS num_instantiated_cells,
  (o_orderkey % 97) / 1000.0::DOUBLE AS total_time FROM orders),
 mn(dataset, least) AS (VALUES ('airport', 5), ('hospital', 9), ('adult', 9), ('flight', 11), ('tax', 3))"""


def _runs(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    names = F.array(*[F.lit(d) for d in ("airport", "hospital", "adult", "flight", "tax")])
    return table(spark, sf_dir, "orders").select(
        F.when(k % 2 == 0, "exp").otherwise("gum").alias("method"), F.get(names, (F.floor(k / 2) % 5).cast("int")).alias("dataset"), ((1 + c % 10) / 10.0).alias("epsilon_m"), ((k % 11) / 10.0).alias("L0"),
        (((k * 7919) % 1000) / 1000.0).alias("leakage"), (c % 7).cast("int").alias("mask_size"), F.lit(12).alias("num_instantiated_cells"), ((k % 97) / 1000.0).alias("total_time"),
        F.lit(0.0).alias("init_time"), ((k % 97) / 1000.0).alias("model_time"), F.lit(0.0).alias("del_time"),
    )


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double" and c not in ("epsilon_m", "L0", "tau0", "epsilon")})


@query(f"""WITH {RUNS_SQL} SELECT method, dataset, epsilon_m, L0, count(*) AS n, round(avg(mask_size), 6) AS mean_mask, round(1.96 * coalesce(stddev_samp(mask_size), 0) / sqrt(count(*)), 6) AS ci_mask, round(avg(leakage), 6) AS mean_leakage,
 round(1.96 * coalesce(stddev_samp(leakage), 0) / sqrt(count(*)), 6) AS ci_leakage, round(100 * abs(any_value(least) - avg(mask_size)) / any_value(least), 6) AS improvement, round(100 * 1.96 * coalesce(stddev_samp(mask_size), 0) / sqrt(count(*)) / any_value(least), 6) AS ci_improvement FROM r JOIN mn USING (dataset) GROUP BY ALL""")
def curve_stats(spark, sf_dir):
    """Means and half widths by budget and cap."""
    return _rounded(report.curves(_runs(spark, sf_dir)))


@query(f"WITH {RUNS_SQL} SELECT dataset, method, epsilon_m, L0, round(avg(100 * (least - mask_size)::DOUBLE / least), 6) + 0 AS improvement FROM r JOIN mn USING (dataset) GROUP BY ALL")
def improvement_signed(spark, sf_dir):
    """Signed improvements."""
    return _rounded(report.signed_improvement(_runs(spark, sf_dir)))


@query(f"WITH {RUNS_SQL} SELECT method, dataset, epsilon_m, L0, round(avg(mask_size), 6) AS mean_mask, round(avg(leakage), 6) AS mean_leakage, round(avg(mask_size) / any_value(least), 6) AS relative_size FROM r JOIN mn USING (dataset) WHERE epsilon_m IN (0.1, 1.0) GROUP BY ALL")
def pareto(spark, sf_dir):
    """Mask size against leakage at two budgets."""
    return _rounded(report.pareto(_runs(spark, sf_dir)))


@query(f"""WITH {RUNS_SQL}, l(position, method) AS (VALUES (0, 'min'), (1, 'exp'), (2, 'gum')) SELECT position, l.method, 0.0::DOUBLE AS init_time, round(coalesce(avg(total_time) * 1000, 0), 6) AS model_time, 0.0::DOUBLE AS del_time, round(coalesce(avg(total_time) * 1000, 0), 6) AS total_time FROM l LEFT JOIN r ON r.method = l.method GROUP BY ALL""")
def runtime_breakdown(spark, sf_dir):
    """Mean phase times in a fixed order of methods."""
    return _rounded(report.runtime_breakdown(_runs(spark, sf_dir)))


@query(f"""WITH {RUNS_SQL} SELECT method, dataset, round(avg(mask_size), 6) AS avg_mask_size, round(avg(leakage), 6) AS avg_leakage, round(1.96 * coalesce(stddev_samp(leakage), 0) / sqrt(count(*)), 6) AS leakage_ci_margin_95, round(avg(mask_size / 12.0::DOUBLE), 6) AS avg_deletion_ratio,
 round(avg((1 - leakage) / (mask_size + 1)), 6) AS avg_efficiency, round(100 * abs(any_value(least) - avg(mask_size)) / any_value(least), 6) AS mask_improvement_percent, round(avg(total_time) * 1000, 6) AS avg_time_ms FROM r JOIN mn USING (dataset) GROUP BY ALL""")
def main_metrics(spark, sf_dir):
    """The main statistics by method and dataset."""
    return _rounded(report.main_metrics(_runs(spark, sf_dir)))


@query(f"""{LEAK_SQL} SELECT ds AS dataset, sz AS mask_size, count(*) AS n, round(100 * avg(nor), 6) AS mean_leakage_noisy_or, round(100 * avg(gre), 6) AS mean_leakage_greedy, round(100 * avg(mx), 6) AS mean_leakage_max,
 round(100 * coalesce(stddev_samp(nor), 0), 6) AS std_leakage_noisy_or, round(100 * coalesce(stddev_samp(gre), 0), 6) AS std_leakage_greedy, round(100 * coalesce(stddev_samp(mx), 0), 6) AS std_leakage_max FROM lk GROUP BY ALL""")
def leak_by_size(spark, sf_dir):
    """Three estimators by mask size."""
    return _rounded(report.leakage_by_size(_leakage(spark, sf_dir)[2]))


@query(f"""WITH {RUNS_SQL}, g AS (SELECT dataset, L0, epsilon_m, avg(100 * (least - mask_size)::DOUBLE / least) AS i FROM r JOIN mn USING (dataset) WHERE method = 'exp' GROUP BY ALL)
 SELECT L0, round(avg(i) FILTER (epsilon_m = 0.1), 6) AS eps_0_1, round(avg(i) FILTER (epsilon_m = 0.5), 6) AS eps_0_5, round(avg(i) FILTER (epsilon_m = 1.0), 6) AS eps_1_0 FROM g GROUP BY L0 HAVING L0 < (SELECT max(L0) FROM g)""")
def heatmap_pivot(spark, sf_dir):
    """Caps down, budgets across."""
    rows = report.signed_improvement(_runs(spark, sf_dir)).filter("method = 'exp'")
    return _rounded(report.heatmap(rows, [0.1, 0.5, 1.0]))


@query(f"""WITH {RUNS_SQL}, g AS (SELECT dataset, method, L0, epsilon_m, avg(100 * (least - mask_size)::DOUBLE / least) AS i FROM r JOIN mn USING (dataset) GROUP BY ALL),
 t AS (SELECT *, exp(epsilon_m) * L0 / ((1 - L0) + exp(epsilon_m) * L0) AS tau FROM g)
 SELECT dataset, method, tau0, round(max(i), 6) AS best, round(min(i), 6) AS worst, count(*) AS n FROM t, (VALUES (0.2::DOUBLE), (0.4::DOUBLE), (0.6::DOUBLE), (0.8::DOUBLE)) v(tau0) WHERE abs(tau - tau0) <= 0.04 GROUP BY ALL""")
def tau_contour(spark, sf_dir):
    """Best and worst improvement near some certainties."""
    return _rounded(report.tau_extremes(report.signed_improvement(_runs(spark, sf_dir))))


@query(f"""WITH {RUNS_SQL} SELECT epsilon_m AS epsilon, L0 AS cap, round(exp(epsilon_m) * L0 / ((1 - L0) + exp(epsilon_m) * L0), 9) AS tau, round(0.5 / (exp(epsilon_m) * 0.5 + 0.5), 9) AS cap_at_half, count(*) AS n FROM r GROUP BY epsilon_m, L0""")
def budget_split(spark, sf_dir):
    """Certainty by the runs' budgets and caps, and the cap at which certainty is one half."""
    at = _runs(spark, sf_dir).groupBy(F.col("epsilon_m").alias("epsilon"), F.col("L0").alias("cap")).agg(F.count(F.lit(1)).alias("n"))
    return at.select("epsilon", "cap", F.round(X.budget_share(F.col("epsilon"), F.col("cap")), 9).alias("tau"), F.round(X.cap_of_share(F.lit(0.5), F.col("epsilon")), 9).alias("cap_at_half"), "n")


CURVE_SQL = "kn AS (SELECT o_orderpriority AS curve, (o_custkey % 40)::DOUBLE AS x, min(o_totalprice) AS y FROM orders WHERE o_custkey % 3 != 0 GROUP BY ALL), wt AS (SELECT DISTINCT o_orderpriority AS curve, (o_custkey % 50)::DOUBLE - 4.5::DOUBLE AS x FROM orders)"


@query(f"""WITH {CURVE_SQL}, n AS (SELECT w.curve, w.x, max(k.x) FILTER (k.x <= w.x) AS a, min(k.x) FILTER (k.x >= w.x) AS b FROM wt w JOIN kn k ON k.curve = w.curve GROUP BY w.curve, w.x)
 SELECT n.curve, n.x, round(CASE WHEN a IS NULL THEN q.y WHEN b IS NULL OR a = b THEN p.y ELSE p.y + (n.x - a) / (b - a) * (q.y - p.y) END, 6) AS y FROM n LEFT JOIN kn p ON p.curve = n.curve AND p.x = a LEFT JOIN kn q ON q.curve = n.curve AND q.x = b""")
def interpolation(spark, sf_dir):
    """Each priority's least price by customer group as a piecewise linear curve, read between and beyond its points."""
    o = table(spark, sf_dir, "orders")
    curve = F.col("o_orderpriority").alias("curve")
    known = o.filter(F.col("o_custkey") % 3 != 0).groupBy(curve, (F.col("o_custkey") % 40).cast("double").alias("x")).agg(F.min("o_totalprice").alias("y"))
    wanted = o.select(curve, ((F.col("o_custkey") % 50).cast("double") - 4.5).alias("x")).distinct()
    return report.interpolated(known, wanted, "x", "y", "curve").select("curve", "x", F.round("y", 6).alias("y"))


def _sweep(spark, sf_dir):
    from veilgraph.operators.sweep import run_sweep

    model, scratch, t = _leakage(spark, sf_dir)
    return run_sweep(model, t, scratch, orderings=mechanisms.ORDERINGS)


@query()
def sweep(spark, sf_dir):
    """Run records of all methods at all 110 points, 100 draws each, for all five catalogs."""
    return _sweep(spark, sf_dir)


def _sweep_sql() -> str:
    """Expected records by point: distribution functions of all masks and of three orderings' prefixes, met by 100 repeatable draws."""
    ctes, parts = [], []
    orders = {"exp": None, "gum": GREEDY_ORDER, "gum_zero": "nm.pos", "gum_random": _RANDOM_ORDER}
    for k, (method, order) in enumerate(orders.items()):
        if order is None:
            ctes.append(f"c{k} AS (SELECT ds, n, mask, sz, gre FROM lk)")
        else:
            own = _bits_sql(order)
            for name in ("od", "pf"):
                own = re.sub(rf"\b{name}\b", f"{name}{k}", own)
            ctes += [own, f"c{k} AS (SELECT pf{k}.ds, n, mask, sz, gre FROM pf{k} JOIN lk USING (ds, mask))"]
        ctes.append(f"""u{k} AS (SELECT ds, n, mask, sz, gre, epsilon, cap, epsilon * (-sz::DOUBLE - CASE WHEN gre > cap THEN 1000.0::DOUBLE ELSE 0.0::DOUBLE END) * n / 2 AS s FROM c{k}, gd),
 x{k} AS (SELECT *, exp(s - max(s) OVER (PARTITION BY ds, epsilon, cap)) AS x FROM u{k}),
 p{k} AS (SELECT *, x / sum(x) OVER (PARTITION BY ds, epsilon, cap) AS p FROM x{k}),
 h{k} AS (SELECT *, sum(p) OVER (PARTITION BY ds, epsilon, cap ORDER BY sz, mask ROWS UNBOUNDED PRECEDING) AS hi FROM p{k}),
 d{k} AS (SELECT ds, epsilon, cap, ({_hash_sql(f"'{7 if order is None else 8}'", "ds", TARGET_SQL, "epsilon::VARCHAR", "cap::VARCHAR", "it::VARCHAR")} + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM m, gd, (SELECT unnest(range(0, 100)) AS it)),
 f{k} AS (SELECT d{k}.ds, d{k}.epsilon, d{k}.cap, sz, gre FROM d{k} ASOF JOIN (SELECT * FROM h{k} WHERE p > 1e-15) h ON h.ds = d{k}.ds AND h.epsilon = d{k}.epsilon AND h.cap = d{k}.cap AND h.hi >= d{k}.u)""")
        parts.append(f"SELECT '{method}' AS method, ds AS dataset, epsilon AS epsilon_m, cap AS L0, count(*) AS n, sum(sz)::BIGINT AS total_mask, round(avg(gre), 6) AS mean_leakage FROM f{k} GROUP BY ALL")
    grid = "gd AS (SELECT e / 10.0::DOUBLE AS epsilon, c / 10.0::DOUBLE AS cap FROM range(1, 11) a(e), range(0, 11) b(c))"
    return f"{LEAK_SQL}, {grid}, {', '.join(ctes)} {' UNION ALL '.join(parts)}"


@query(_sweep_sql())
def sweep_points(spark, sf_dir):
    """The private methods' records of the sweep by method, catalog and point."""
    return _sweep(spark, sf_dir).filter("method != 'min'").groupBy("method", "dataset", "epsilon_m", "L0").agg(F.count(F.lit(1)).alias("n"), F.sum("mask_size").alias("total_mask"), F.round(F.avg("leakage"), 6).alias("mean_leakage"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer a deletion request: the private mask for its catalog, and the customer's row without the cells asked for."""
    model, _, t = _leakage(spark, ("airport",))
    chosen = mechanisms.draw(mechanisms.probabilities(mechanisms.all_mask_candidates(t, model), mechanisms.points(spark, [0.1], [0.2])), 100, seed=7)
    customers = table(spark, sf_dir, "customer").withColumn("iteration", (F.col("c_custkey") % 100).cast("int"))
    return customers.join(F.broadcast(chosen), "iteration").select("c_custkey", "dataset", "target", "mask", "mask_size", F.round("leakage", 9).alias("leakage"))  # 100 draws
