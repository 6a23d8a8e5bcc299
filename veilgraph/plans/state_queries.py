"""Queries over tables that change: files rewritten in place, insertion times kept by a stream, a stream of requests, whole requests and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilgraph.operators import dependencies, deletion, leakage, mechanisms, report, templates
from veilgraph.operators.file_table import FileTable
from veilgraph.plans import mined
from veilgraph.plans.driver import EM_SQL, GREEDY_SQL, LEAK_SQL, MASKS_SQL, MODEL_SQL, RUNS_SQL, _chains_sql, _hash_sql, _leakage, _model, _rounded, _runs, query, table
from veilgraph.sources import runs
from veilgraph.store import Scratch
from veilgraph.streaming.requests import answer_stream
from veilgraph.streaming.times import keep_newest_times, newest_times, times_by_key

_KEYS = "c_custkey < (SELECT count(*) FROM customer) / 5"


@query(f"""SELECT c_custkey, CASE WHEN {_KEYS} AND c_custkey % 7 = 0 THEN NULL ELSE c_name END AS c_name, c_nationkey, CASE WHEN {_KEYS} AND c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, 1 AS version, true AS few FROM customer""")
def update_in_place(spark, sf_dir):
    """Cells deleted in a table of files: only files with requested keys are written anew. The rows, their version, and whether most files stayed."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    kept = FileTable(spark, f"{Scratch(spark).root}/customers", "c_custkey")
    kept.create(c.repartitionByRange(20, "c_custkey"))
    before = set(kept.files())
    ask = c.filter((F.col("c_custkey") < c.count() / 5) & (F.col("c_custkey") % 7 == 0)).select("c_custkey", F.array(F.lit("c_name"), F.lit("c_acctbal")).alias("names"))
    version = kept.delete_cells(ask)
    stayed = len(before & set(kept.files()))
    return kept.read().select("*", F.lit(version).alias("version"), F.lit(stayed >= 0.7 * len(before)).alias("few"))


@query("SELECT user_id AS key, event_type AS attribute, max(ts) AS time FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL GROUP BY ALL")
def newest_insertion_times(spark, sf_dir):
    """The newest time of each user's cell, kept by a stream over the events."""
    root = Scratch(spark).root
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    keep_newest_times(events, "user_id", "event_type", "ts", f"{root}/times", f"{root}/state").awaitTermination()
    return newest_times(spark, f"{root}/times").withColumn("time", F.col("time").cast("timestamp_ntz"))


@query("""WITH t AS (SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY ALL), p AS (SELECT user_id, max(floor(epoch(ts))::BIGINT) FILTER (event_type = 'click') AS a, max(floor(epoch(ts))::BIGINT) FILTER (event_type = 'view') AS b FROM t GROUP BY 1)
 SELECT c_custkey, coalesce(a, 0) AS click, coalesce(b, 0) AS view FROM customer LEFT JOIN p ON user_id = c_custkey""")
def times_of_requests(spark, sf_dir):
    """Requests with the times that the stream has kept for their key; cells never filled count as 0."""
    root = Scratch(spark).root
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    keep_newest_times(events, "user_id", "event_type", "ts", f"{root}/times", f"{root}/state").awaitTermination()
    times = times_by_key(newest_times(spark, f"{root}/times"), ["click", "view"])
    of = lambda name: F.coalesce(F.try_element_at("times", F.lit(name)), F.lit(0).cast("long")).alias(name)
    return deletion.with_insertion_times(table(spark, sf_dir, "customer").select("c_custkey"), times, "c_custkey").select("c_custkey", of("click"), of("view"))


_SOURCE = mined.SOURCES["customer"]
_ATTRIBUTES = list(_SOURCE.attributes)


def _request_sql() -> str:
    """Each customer's private mask at one point, drawn by md5 from the distribution function, and the row without its cells and the target."""
    bits = ", ".join(f"(SELECT coalesce(max(bit), 0) FROM nm WHERE ds = 'customer' AND name = '{a}') AS b_{a}" for a in _ATTRIBUTES if a != _SOURCE.target)
    cells = ", ".join(f"CASE WHEN mask & b_{a} != 0 THEN NULL ELSE {a} END AS {a}" for a in _ATTRIBUTES if a != _SOURCE.target)
    return f"""{EM_SQL}, cd AS (SELECT mask, sz, sum(p) OVER (ORDER BY sz, mask ROWS UNBOUNDED PRECEDING) AS hi FROM em WHERE ds = 'customer' AND eps = 0.5 AND cap = 0.4),
 v AS ({_SOURCE.sql()}), dw AS (SELECT v.*, ({_hash_sql("'9'", "'customer'", f"'{_SOURCE.target}'", "k::VARCHAR")} + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM v),
 ch AS (SELECT k, arg_min(mask, (hi, sz, mask)) AS mask FROM dw JOIN cd ON hi >= u GROUP BY k), bt AS (SELECT {bits})
 SELECT dw.k, CAST(NULL AS INTEGER) AS {_SOURCE.target}, {cells} FROM dw JOIN ch ON ch.k = dw.k, bt"""


@query(_request_sql().replace("ch AS (SELECT k,", "cz AS (SELECT k,").replace("JOIN ch ON ch.k = dw.k", "JOIN cz ON cz.k = dw.k"))
def stream_requests(spark, sf_dir):
    """A stream of deletion requests, one for each customer: every row without the cells of its private mask and the target."""
    model, _, t = _leakage(spark, sf_dir)
    model, t = (df.filter("dataset = 'customer'") for df in (model, t))
    chosen = mechanisms.probabilities(mechanisms.all_mask_candidates(t, model), mechanisms.points(spark, [0.5], [0.4]))
    root = Scratch(spark).root
    asked = spark.readStream.schema(table(spark, sf_dir, "customer").schema).option("pathGlobFilter", "customer.parquet").parquet(sf_dir)
    asked = asked.select(F.col("c_custkey").alias("k"), F.lit("customer").alias("dataset"), F.lit(_SOURCE.target).alias("target"))
    rows = _SOURCE.rows(spark, sf_dir)
    answer_stream(asked, rows, chosen, model, "k", f"{root}/answers", f"{root}/state", seed=9).awaitTermination()
    return spark.read.parquet(f"{root}/answers").select("k", F.col(_SOURCE.target).cast("int").alias(_SOURCE.target), *[a for a in _ATTRIBUTES if a != _SOURCE.target])


@query("SELECT o_orderstatus, count(*) AS n, count(o_custkey) AS n_custkey, false AS there FROM orders GROUP BY 1")
def working_copies(spark, sf_dir):
    """A working copy of orders whose cells are deleted while the table stays; it is gone afterwards."""
    from veilgraph.sources.runs import table_exists

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    with deletion.working_copy(orders, "orders_copy") as copy:
        path = copy.inputFiles()[0].rsplit("/", 1)[0]
        ask = copy.filter("o_orderkey % 3 = 0").select("o_orderkey", F.array(F.lit("o_custkey")).alias("names"))
        assert deletion.mask_to_null(copy, ask, "o_orderkey").filter("o_custkey IS NULL").count() > 0
    there = table_exists(spark, path)
    return orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count("o_custkey").alias("n_custkey")).withColumn("there", F.lit(there))


@query(f"""WITH {RUNS_SQL} SELECT method, dataset, count(*) AS n, round(avg(mask_size), 6) AS avg_mask_size, round(avg(leakage), 6) AS avg_leakage FROM r GROUP BY ALL""")
def statistics_file(spark, sf_dir):
    """The main statistics written as a CSV file and read back."""
    rows = _runs(spark, sf_dir)
    found = report.main_metrics(rows).join(rows.groupBy("method", "dataset").agg(F.count(F.lit(1)).alias("n")), ["method", "dataset"])
    path = f"{Scratch(spark).root}/statistics"
    runs.write_statistics(found, path)
    back = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return _rounded(back.select("method", "dataset", F.col("n").cast("long").alias("n"), "avg_mask_size", "avg_leakage"))


@query("""WITH x AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY ALL), y AS (SELECT l_returnflag, sum(n) AS n, max(n) AS top FROM x GROUP BY 1), t AS (SELECT sum(n)::DOUBLE AS t FROM x),
 h AS (SELECT -sum(n / t * ln(n / t)) AS h FROM (SELECT l_linestatus, sum(n) AS n FROM x GROUP BY 1), t), g AS (SELECT -sum(x.n / t * ln(x.n / y.n::DOUBLE)) AS g FROM x JOIN y USING (l_returnflag), t)
 SELECT 'average' AS method, round(sum(top) / sum(n)::DOUBLE, 6) AS weight FROM y UNION ALL SELECT 'worst_case', round(min(top / n::DOUBLE), 6) FROM y UNION ALL SELECT 'entropy', round(greatest(0.0::DOUBLE, 1 - g / h), 6) FROM h, g""")
def dependency_weights(spark, sf_dir):
    """The weight of a dependency by each of the three methods."""
    out = None
    for method in dependencies.METHODS:
        one = dependencies.dependency_weight(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linestatus", method).select(F.lit(method).alias("method"), F.round("weight", 6).alias("weight"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH RECURSIVE {MODEL_SQL}, u AS (SELECT DISTINCT ds, em FROM e)
 SELECT m.ds AS dataset, m.n AS zone_size, (SELECT count(*) FROM e WHERE e.ds = m.ds) AS n_edges, (SELECT count(*) FROM u WHERE u.ds = m.ds) AS n_unique, (SELECT sum(bit_count(em))::BIGINT FROM u WHERE u.ds = m.ds) AS n_members FROM m""")
def model_summary(spark, sf_dir):
    """What a model holds: its zone, edges, different edges and their members; and that its size in bytes is known."""
    model, _ = _model(spark, sf_dir)
    sizes = templates.model_sizes(model).filter("bytes > 0").select("dataset", "target")
    unique = F.array_distinct(F.transform("edges", lambda e: e["mask"]))
    members = F.aggregate(unique, F.lit(0).cast("long"), lambda s, e: s + F.bit_count(e))
    return model.join(sizes, ["dataset", "target"]).select("dataset", F.col("n").alias("zone_size"), F.size("edges").cast("long").alias("n_edges"), F.size(unique).cast("long").alias("n_unique"), members.alias("n_members"))


@query()
def price_splines(spark, sf_dir):
    """Each priority's mean price by month as a curve through its points."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.month("o_orderdate").alias("month"), "o_totalprice")
    return _rounded(report.smoothed(o, "month", "o_totalprice", "o_orderpriority", places=45, start=None, low=0.0))


#: Models whose edges fit the bits of one number, so that SQL can tell which edges two chains share.
BOUNDED = ("airport", "hospital", "tax", *mined.SOURCES)


def _bound_sql() -> str:
    """Chains with the edges that they use, and the second-order bound from their pairs: two weights' product over that of the shared edges."""
    names = ", ".join(f"'{d}'" for d in BOUNDED)
    chains = _chains_sql().replace(MASKS_SQL, f"mk AS (SELECT ds, n, t, unnest(range(0, t))::BIGINT AS mask FROM m WHERE ds IN ({names}))")
    for old, new in (
        ("inf, done) AS (", "inf, done, used) AS ("),
        ("eid, w, got, fin FROM (", "eid, w, got, fin, used FROM ("),
        ("em & t != 0 AS fin\n        FROM mk k", "em & t != 0 AS fin, (1::BIGINT << eid) AS used\n        FROM mk k"),
        ("AS got\n        FROM st s JOIN e", "AS got, s.used | (1::BIGINT << e.eid) AS used\n        FROM st s JOIN e"),
    ):
        assert old in chains
        chains = chains.replace(old, new)
    return f"""WITH {chains}, {GREEDY_SQL},
 cn AS MATERIALIZED (SELECT row_number() OVER () AS c, ds, mask, w, used FROM ch),
 pq AS (SELECT p.ds, p.mask, p.used & q.used AS common, sum(p.w * q.w) AS s FROM cn p JOIN cn q ON q.ds = p.ds AND q.mask = p.mask AND p.c < q.c GROUP BY ALL),
 sh AS (SELECT ds, common, (SELECT coalesce(product(e.w), 1.0::DOUBLE) FROM e WHERE e.ds = d.ds AND (d.common >> e.eid) & 1 = 1) AS w FROM (SELECT DISTINCT ds, common FROM pq) d),
 pr AS (SELECT pq.ds, pq.mask, sum(pq.s / sh.w) AS s FROM pq JOIN sh ON sh.ds = pq.ds AND sh.common = pq.common GROUP BY ALL),
 sg AS (SELECT ds, mask, sum(w) AS s FROM cn GROUP BY ALL)
 SELECT lk.ds AS dataset, lk.mask, round(coalesce(least(lk.nor, greatest(0.0::DOUBLE, least(1.0::DOUBLE, sg.s - coalesce(pr.s, 0.0::DOUBLE)))), 0.0::DOUBLE), 6) AS leakage FROM lk LEFT JOIN sg ON sg.ds = lk.ds AND sg.mask = lk.mask LEFT JOIN pr ON pr.ds = lk.ds AND pr.mask = lk.mask"""


@query(_bound_sql())
def leak_ie2_bounded(spark, sf_dir):
    """The second-order bound of every mask of the smaller catalogs and of the tables."""
    model = _model(spark, sf_dir)[0].filter(F.col("dataset").isin(*BOUNDED))
    return leakage.leakage_table(model, Scratch(spark), method="nor_with_ie").select("dataset", "mask", F.round("leakage_ie", 6).alias("leakage"))


def _charts_sql() -> str:
    """Rows of every chart's table."""
    short = "dataset IN (" + ", ".join(f"'{d}'" for d in report.SHORT) + ")"
    points = lambda where: f"SELECT count(DISTINCT (method, dataset, epsilon_m, L0)) FROM r WHERE {where}"
    grid = lambda where: f"SELECT count(DISTINCT (method, dataset, L0)) FROM r WHERE {where} AND L0 < (SELECT max(L0) FROM r WHERE {where})"
    two = "epsilon_m IN (0.1, 1.0)"
    tau = "exp(epsilon_m) * L0 / ((1 - L0) + exp(epsilon_m) * L0)"
    charts = {
        "8": points(short), "9": points(f"{short} AND {two}"), "10": "SELECT 3", "11": grid(short), "12": points("method = 'exp'"), "13": points("method = 'gum'"), "14": points(two),
        "16": "SELECT count(DISTINCT (ds, sz)) FROM lk", "16_curves": "SELECT 300 * count(DISTINCT ds) FROM lk", "17a": points("method = 'gum'"), "17b": "SELECT 0", "17c": "SELECT 0", "18a": points("method = 'gum'"), "18b": "SELECT 0", "18c": "SELECT 0", "19": grid("true"),
        "20": f"SELECT count(DISTINCT (dataset, method, tau0)) FROM r, (VALUES (0.2::DOUBLE), (0.4::DOUBLE), (0.6::DOUBLE), (0.8::DOUBLE)) v(tau0) WHERE abs({tau} - tau0) <= 0.04",
    }
    return f"{LEAK_SQL}, {RUNS_SQL} " + " UNION ALL ".join(f"SELECT '{k}' AS chart, ({v})::BIGINT AS n" for k, v in charts.items())


@query(_charts_sql())
def chart_tables(spark, sf_dir):
    """The tables that all charts are drawn from, and their rows."""
    model, _, t = _leakage(spark, sf_dir)
    out = None
    for name, chart in report.figures(_runs(spark, sf_dir), leakage.all_masks(t, model)).items():
        one = chart.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("chart"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT * FROM (VALUES ('main', 50::BIGINT), ('masks', 72::BIGINT), ('runs', 250::BIGINT)) v(name, n) UNION ALL SELECT 'tables/airport', count(*) FROM customer UNION ALL SELECT 'tables/tax', count(*) FROM customer""")
def whole_run(spark, sf_dir):
    """The whole experiment over two datasets whose tables are loaded from files of customers: rows of the tables, runs, masks and the main point."""
    from veilgraph.plans.source_queries import _file
    from veilgraph.plans.whole import run_all

    files = {n: _file(spark, sf_dir, n) for n in ("airport", "tax")}
    got = run_all(spark, files, f"{Scratch(spark).root}/whole", names=("tax", "airport"), epsilons=(0.1, 0.5, 1.0), caps=(0.2, 0.3), iterations=5)
    out = None
    for name in ("main", "masks", "runs", "tables/airport", "tables/tax"):
        one = got[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH RECURSIVE {MODEL_SQL}, x AS (SELECT ds, em, row_number() OVER (PARTITION BY ds ORDER BY em) - 1 AS no FROM (SELECT DISTINCT ds, em FROM e)),
 mb AS (SELECT x.ds, no, pos + 1 AS c FROM x JOIN nm ON nm.ds = x.ds AND em & bit != 0 UNION ALL SELECT x.ds, no, 0 FROM x JOIN m ON m.ds = x.ds AND em & t != 0)
 SELECT a.ds AS dataset, ' closure_e' || a.no || '_h' || a.c || ': r' || a.c || coalesce(string_agg(' - r' || b.c, '' ORDER BY b.c), '') || ' >= ' || (1 - count(b.c)) AS line FROM mb a LEFT JOIN mb b ON b.ds = a.ds AND b.no = a.no AND b.c != a.c GROUP BY a.ds, a.no, a.c
 UNION ALL SELECT ds, ' visible_implies_known_' || c || ': a' || c || ' + r' || c || ' >= 1' FROM (SELECT ds, unnest(range(0, n + 1)) AS c FROM m)""")
def lp_lines(spark, sf_dir):
    """The constraints of the integer program of every model, line by line."""
    lines = mechanisms.program_lines(_model(spark, sf_dir)[0])
    return lines.filter(F.col("line").startswith(" closure_") | F.col("line").startswith(" visible_")).select("dataset", "line")
