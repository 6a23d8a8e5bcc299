"""Constraints over the given tables, weighted from sampled pairs of their rows, and the models that follow from the kept ones.

Every attribute is an expression that Spark and DuckDB both read, so the SQL of this module gives the same weights, zones and
edges from the same tables. Its CTEs, with those of the five catalogs, are what the oracles of leakage and mechanisms build on.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.functions.expressions import Z_VALUES
from veilgraph.operators import pairs, weights
from veilgraph.sources.constraints import PREDICATES, predicates_of_text

#: Sampled pairs of each table, the threshold of a weight, and the least pairs that fulfil a constraint's premise.
PAIRS, GAMMA, LEAST = 60_000, 0.05, 50


@dataclass(frozen=True)
class Source:
    """A table's rows (a FROM clause over the given tables), their key, attributes as SQL, the target, and constraints as ``a== b!=``."""

    tables: tuple[str, ...]
    key: str
    attributes: dict[str, str]
    target: str
    constraints: tuple[str, ...]
    on: str = ""
    grouped: bool = False

    def lines(self) -> list[str]:
        found = []
        for text in self.constraints:
            parts = [re.fullmatch(r"(\w+)(==|!=|<=|>=|<|>)", p).groups() for p in text.split()]
            found.append("not (" + " and ".join(f"t1.{a}{op}t2.{a}" for a, op in parts) + ")")
        return found

    def predicates(self) -> list[list[pairs.Predicate]]:
        return [[(0, a, op, 1, a) for a, op in re.findall(r"t1\.(\w+)(==|!=|<=|>=|<|>)", line)] for line in self.lines()]

    def rows(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        found = spark.read.parquet(f"{sf_dir}/{self.tables[0]}.parquet")
        for other in self.tables[1:]:
            found = found.join(spark.read.parquet(f"{sf_dir}/{other}.parquet"), F.expr(self.on))
        if self.grouped:
            return found.groupBy(F.expr(self.key).alias("k")).agg(*[F.expr(x).alias(a) for a, x in self.attributes.items()])
        return found.select(F.expr(self.key).alias("k"), *[F.expr(x).alias(a) for a, x in self.attributes.items()])

    def sql(self) -> str:
        joined = self.tables[0] + "".join(f" JOIN {t} ON {self.on}" for t in self.tables[1:])
        return f"SELECT {self.key} AS k, {', '.join(f'{x} AS {a}' for a, x in self.attributes.items())} FROM {joined}" + (f" GROUP BY {self.key}" if self.grouped else "")


SOURCES = {
    "customer": Source(
        ("customer", "nation"),
        "c_custkey",
        {
            "nation": "n_name", "region": "n_regionkey", "segment": "c_mktsegment", "market": "c_mktsegment || CAST(n_regionkey AS STRING)", "balance": "c_acctbal", "tier": "CAST(floor(c_acctbal / 2000) AS INT)",
            "debt": "CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END", "class": "CAST(floor(c_acctbal / 2000) AS INT) * 10 + n_regionkey",
        },
        "region",
        ("nation== region!=", "region== nation!=", "market== region!=", "market== segment!=", "segment== market!=", "balance< tier>", "tier< balance>", "tier== debt!=", "debt== tier!=", "class== tier!=", "class== region!=", "segment== nation!=", "nation== segment== market!="),
        "c_nationkey = n_nationkey",
    ),
    "lineitem": Source(
        ("lineitem",),
        "l_partkey",
        {
            "lines": "count(*)", "units": "CAST(sum(l_quantity) AS BIGINT)", "returns": "sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)", "volume": "CAST(floor(sum(l_quantity) / 100) AS INT)",
            "any_return": "max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)", "top": "max(l_extendedprice)", "last": "max(year(l_shipdate))",
        },
        "lines",
        ("lines< units>", "units< lines>", "lines< returns>", "returns< lines>", "units< volume>", "volume< units>", "returns== any_return!=", "any_return== returns!=", "volume== lines!=", "last== top!=", "lines< volume>"),
        grouped=True,
    ),
    "orders": Source(
        ("orders",),
        "o_orderkey",
        {
            "status": "o_orderstatus", "priority": "o_orderpriority", "urgent": "CASE WHEN o_orderpriority < '3' THEN 1 ELSE 0 END", "price": "o_totalprice", "band": "CAST(floor(o_totalprice / 40000) AS INT)",
            "year": "year(o_orderdate)", "quarter": "quarter(o_orderdate)", "month": "month(o_orderdate)", "period": "year(o_orderdate) * 10 + quarter(o_orderdate)",
            "cohort": "o_orderstatus || o_orderpriority", "scale": "CAST(floor(o_totalprice / 40000) AS INT) * 10 + quarter(o_orderdate)",
        },
        "quarter",
        (
            "month== quarter!=", "quarter== month!=", "period== quarter!=", "period== year!=", "year== period!=", "scale== quarter!=", "scale== band!=", "price< band>", "band< price>", "year== month== period!=",
            "cohort== status!=", "cohort== priority!=", "priority== urgent!=", "urgent== priority!=", "status== priority!=",
        ),
    ),
    "part": Source(
        ("part",),
        "p_partkey",
        {
            "brand": "p_brand", "maker": "substr(p_brand, 1, 7)", "type": "p_type", "size": "p_size", "price": "p_retailprice", "sizeband": "CAST(floor(p_size / 10) AS INT)", "bracket": "CAST(floor(p_retailprice / 100) AS INT)",
            "line": "p_type || CAST(CAST(floor(p_size / 10) AS INT) AS STRING)", "kit": "substr(p_brand, 1, 7) || CAST(CAST(floor(p_size / 10) AS INT) AS STRING)",
        },
        "sizeband",
        ("brand== maker!=", "maker== brand!=", "size< sizeband>", "sizeband< size>", "sizeband== size!=", "price< bracket>", "bracket< price>", "line== type!=", "line== sizeband!=", "type== line!=", "kit== maker!=", "kit== sizeband!=", "brand== type!="),
    ),
}
TARGETS = {d: s.target for d, s in SOURCES.items()}


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, target, dc_id, preds, weight) of all constraints over the tables, those without a weight included."""

    def one(name: str) -> list[tuple]:
        source = SOURCES[name]
        sample = pairs.sample_pairs(source.rows(spark, sf_dir), "k", PAIRS)
        best = weights.best_heads(weights.direction_stats(weights.direction_counts(sample, source.predicates(), 0)), LEAST)
        rows = weights.with_gammas(best, (GAMMA,)).select("dc_id", F.round("weight", 6).alias("weight")).collect()  # a row for each constraint
        lines = source.lines()
        return [(name, source.target, r.dc_id, lines[r.dc_id], r.weight) for r in rows]

    with ThreadPoolExecutor(len(SOURCES)) as pool:
        rows = [r for part in pool.map(one, sorted(SOURCES)) for r in part]
    lines = spark.createDataFrame(rows, "dataset string, target string, dc_id int, line string, weight double")
    return lines.select("dataset", "target", "dc_id", predicates_of_text(F.col("line")).cast(PREDICATES).alias("preds"), "weight")


# ---- the same in SQL ----


def _hash(*parts: str) -> str:
    return "('0x' || substr(md5(" + " || '|' || ".join(parts) + "), 1, 8))::BIGINT"


def wilson_sql(k: str, n: str, sign: str) -> str:
    z = Z_VALUES[0.90]
    centre = f"(({k}::DOUBLE / {n} + {z * z!r}::DOUBLE / (2 * {n})) / (1 + {z * z!r}::DOUBLE / {n}))"
    radius = f"({z!r}::DOUBLE * sqrt(({k}::DOUBLE / {n} * (1 - {k}::DOUBLE / {n}) + {z * z!r}::DOUBLE / (4 * {n})) / {n}) / (1 + {z * z!r}::DOUBLE / {n}))"
    if sign == "-":
        return f"CASE WHEN {n} <= 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, {centre} - {radius}) END"
    return f"CASE WHEN {n} <= 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, {centre} + {radius}) END"


def _source_sql(name: str, source: Source) -> tuple[list[str], list[str]]:
    """CTEs of a table's sampled pairs, and a count for each constraint and head."""
    v, o, s, p = (f"z_{name}_{x}" for x in "vosp")
    both = ", ".join(f"x.{a} AS l_{a}, y.{a} AS r_{a}" for a in source.attributes)
    draws = f"SELECT pair, {_hash(chr(39) + '7' + chr(39), chr(39) + 'l' + chr(39), 'pair::VARCHAR')} % n AS i, {_hash(chr(39) + '7' + chr(39), chr(39) + 'r' + chr(39), 'pair::VARCHAR')} % (n - 1) + 1 AS st, n FROM (SELECT unnest(range(0, {PAIRS})) AS pair), (SELECT count(*) AS n FROM {v})"
    ctes = [
        f"{v} AS MATERIALIZED ({source.sql()})", f"{o} AS MATERIALIZED (SELECT row_number() OVER (ORDER BY k) - 1 AS rn, * FROM {v})", f"{s} AS MATERIALIZED ({draws})",
        f"{p} AS MATERIALIZED (SELECT {both} FROM {s} s JOIN {o} x ON x.rn = s.i JOIN {o} y ON y.rn = (s.i + s.st) % s.n)",
    ]
    counts = []
    for d, dc in enumerate(source.predicates()):
        tests = [f"l_{a} {'=' if op == '==' else op} r_{a}" for _, a, op, _, _ in dc]
        for j, head in enumerate(tests):
            premise = " AND ".join(t for i, t in enumerate(tests) if i != j)
            counts.append(f"SELECT '{name}' AS ds, {d} AS dc_id, {j} AS head_j, count(*) AS nV, count(*) FILTER (NOT ({head})) AS k0, count(*) FILTER ({premise}) AS nE, count(*) FILTER ({premise} AND NOT ({head})) AS k1 FROM {p}")
    return ctes, counts


def _weights_sql() -> str:
    """CTEs up to z_w(ds, dc_id, w)."""
    ctes, counts = [], []
    for name in sorted(SOURCES):
        own, more = _source_sql(name, SOURCES[name])
        ctes += own
        counts += more
    return ",\n ".join(
        [
            *ctes,
            f"z_ct AS ({' UNION ALL '.join(counts)})",
            f"z_bd AS (SELECT *, {wilson_sql('k0', 'nV', '+')} AS u, {wilson_sql('k1', 'nE', '-')} AS l FROM z_ct)",
            "z_st AS (SELECT ds, dc_id, head_j, CASE WHEN nV >= 200 AND 1 - u > 1e-12 AND nE > 0 THEN nE ELSE 0 END AS nE, CASE WHEN nV >= 200 AND 1 - u > 1e-12 AND nE > 0 THEN (l - u) / (1 - u) ELSE 0.0::DOUBLE END AS base FROM z_bd)",
            f"z_w AS MATERIALIZED (SELECT ds, dc_id, round(greatest(0.0::DOUBLE, CASE WHEN count(*) FILTER (nE >= {LEAST}) = 0 THEN 0.0::DOUBLE ELSE max(base) FILTER (nE >= {LEAST}) END - {GAMMA!r}::DOUBLE), 6) AS w FROM z_st GROUP BY ds, dc_id)",
        ]
    )


def _values(rows: list[tuple]) -> str:
    text = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


WEIGHTS_SQL = _weights_sql()
#: z_l: the constraints' lines; z_k: those with a weight.
_LINES = _values([(d, i, line) for d, s in SOURCES.items() for i, line in enumerate(s.lines())])
KEPT_SQL = f"{WEIGHTS_SQL},\n z_l(ds, dc_id, line) AS (VALUES {_LINES}),\n z_k AS MATERIALIZED (SELECT ds, dc_id, w, line FROM z_w JOIN z_l USING (ds, dc_id) WHERE w > 0)"
_TARGETS = _values(list(TARGETS.items()))
#: z_z: what each target is reached from; z_n: the zone's attributes by name, with their bits; z_m and z_e: the models. Recursive.
ZONES_SQL = f"""{KEPT_SQL},
 z_t(ds, tg) AS (VALUES {_TARGETS}),
 z_a AS MATERIALIZED (SELECT DISTINCT ds, dc_id, unnest(regexp_extract_all(line, 't\\d\\.(\\w+)', 1)) AS attr FROM z_k),
 z_z AS (SELECT ds, tg AS attr FROM z_t UNION SELECT y.ds, y.attr FROM z_z z JOIN z_a x ON x.ds = z.ds AND x.attr = z.attr JOIN z_a y ON y.ds = x.ds AND y.dc_id = x.dc_id),
 z_n AS MATERIALIZED (SELECT ds, (row_number() OVER (PARTITION BY ds ORDER BY attr) - 1)::INTEGER AS pos, attr AS name, (1::BIGINT << (row_number() OVER (PARTITION BY ds ORDER BY attr) - 1)::INTEGER) AS bit FROM z_z JOIN z_t USING (ds) WHERE attr != tg),
 z_m AS MATERIALIZED (SELECT ds, tg, count(*)::INTEGER AS n, (1::BIGINT << count(*)::INTEGER) AS t FROM z_n JOIN z_t USING (ds) GROUP BY ds, tg),
 z_e AS MATERIALIZED (SELECT ds, (row_number() OVER (PARTITION BY ds ORDER BY dc_id) - 1)::INTEGER AS eid, em, w FROM (
   SELECT a.ds, a.dc_id, sum(CASE WHEN a.attr = z_m.tg THEN z_m.t ELSE z_n.bit END)::BIGINT AS em, any_value(z_k.w) AS w FROM z_a a JOIN z_k ON z_k.ds = a.ds AND z_k.dc_id = a.dc_id JOIN z_z ON z_z.ds = a.ds AND z_z.attr = a.attr JOIN z_m ON z_m.ds = a.ds LEFT JOIN z_n ON z_n.ds = a.ds AND z_n.name = a.attr GROUP BY a.ds, a.dc_id))"""
