"""Queries over loaders, sinks and run records. Files are written from the driver's tables first, so DuckDB can work out the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilgraph.functions import expressions as X
from veilgraph.operators import answers, deletion, dependencies, templates
from veilgraph.plans import mined
from veilgraph.plans.driver import CLOSE_SQL, LEAK_SQL, LINES_SQL, MASKS_SQL, MODEL_SQL, RUNS_SQL, _constraints, _hash_sql, _leakage, _parts, _rounded, _runs, plain_model, query, table
from veilgraph.sources import constraints, datasets, runs
from veilgraph.store import Scratch, dealt

#: Raw cells of each dataset's file as SQL over customer; columns that aren't named hold the key.
RAW = {
    "adult": {
        "age": "CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN 'x' ELSE CAST(c_custkey % 90 AS STRING) END", "workclass": "' ' || c_mktsegment || ' '",
        "hours_per_week": "CASE WHEN c_custkey % 17 = 0 THEN '4.5' ELSE CAST(c_custkey % 60 AS STRING) END", "class": "CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '<=50K' END",
    },
    "airport": {
        "ident": "'K' || CAST(c_custkey AS STRING)", "name": "'two\nlines, \"quoted\" ' || c_name", "latitude_deg": "CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN 'x' ELSE CAST(c_acctbal AS STRING) END",
        "elevation_ft": "CASE WHEN c_custkey % 3 = 0 THEN '12.7' ELSE CAST(c_custkey AS STRING) END", "continent": "CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE 'NA' END", "type": "CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'small' END",
    },
    "hospital": {"ProviderNumber": "CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE CAST(c_custkey AS STRING) END", "HospitalName": "c_name", "City": "CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ' ' || c_mktsegment END"},
    "tax": {
        "fname": "CASE WHEN c_custkey % 8 = 0 THEN '' ELSE c_name END", "salary": "CASE WHEN c_custkey % 6 = 0 THEN 'NA' WHEN c_custkey % 7 = 0 THEN '#' ELSE CAST(c_acctbal AS STRING) END", "rate": "CASE WHEN c_custkey % 4 = 0 THEN 'None' ELSE '3.25' END",
        "child_exemp": "CASE WHEN c_custkey % 5 = 0 THEN 'many' ELSE ' -12.9 ' END",
    },
    "flight": {"FlightDate": "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '2020-01-05' END", "Origin": "' ' || c_mktsegment", "Year": "' 2020 '"},
}


def _fields(name: str) -> list[str]:
    return [n for n, _ in datasets._fields(datasets.dataset(name).schema)]


def _cell(name: str, column: str) -> str:
    return RAW[name].get(column, "CAST(c_custkey AS STRING)")


def _file(spark, sf_dir, name: str) -> str:
    """A dataset's CSV files, their rows in key order over the files in the order of their names, with the raw cells of RAW."""
    rows = table(spark, sf_dir, "customer").repartitionByRange("c_custkey").sortWithinPartitions("c_custkey")
    cells = rows.select(*[F.expr(_cell(name, n)).alias(f"{n} str" if name == "airport" else n) for n in _fields(name)])
    path = f"{Scratch(spark).root}/{name}.csv"
    cells.write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)
    return path


def _load(spark, sf_dir, name: str):
    return datasets.dataset(name).load(spark, _file(spark, sf_dir, name))


def _raw_sql(name: str, *columns: str) -> str:
    return "SELECT c_custkey, " + ", ".join(f"trim({_cell(name, n).replace('AS STRING', 'AS VARCHAR')}) AS {n}" for n in columns) + " FROM customer"


_WHOLE = "TRY_CAST(CASE WHEN regexp_full_match({0}, '[+-]?[0-9]+') THEN {0} END AS INTEGER)"


@query(f"""WITH r AS ({_raw_sql("adult", "age", "workclass", "hours_per_week", "class")}), k AS (SELECT *, {_WHOLE.format("age")} AS a, {_WHOLE.format("hours_per_week")} AS h FROM r)
 SELECT row_number() OVER (ORDER BY c_custkey)::INTEGER AS id, a AS age, workclass, h AS hours_per_week, class FROM k WHERE a IS NOT NULL AND h IS NOT NULL""")
def load_adult(spark, sf_dir):
    """A file of people: texts as they are, rows without whole numbers dropped."""
    return _load(spark, sf_dir, "adult").select("id", "age", "workclass", "hours_per_week", "class")


@query(f"""WITH r AS ({_raw_sql("airport", "ident", "type", "name", "latitude_deg", "elevation_ft", "continent")})
 SELECT row_number() OVER (ORDER BY c_custkey)::INTEGER AS id, ident, type, name, TRY_CAST(nullif(latitude_deg, '') AS DOUBLE) AS latitude_deg, trunc(TRY_CAST(elevation_ft AS DOUBLE))::INTEGER AS elevation_ft, nullif(continent, '') AS continent FROM r""")
def load_airport(spark, sf_dir):
    """A file of airports: quoted cells with line breaks, empty as null."""
    return _load(spark, sf_dir, "airport").select("id", "ident", "type", "name", "latitude_deg", "elevation_ft", "continent")


@query(f"""WITH r AS ({_raw_sql("hospital", "ProviderNumber", "HospitalName", "City")})
 SELECT row_number() OVER (ORDER BY c_custkey)::INTEGER AS id, ProviderNumber, nullif(HospitalName, '') AS HospitalName, nullif(City, '') AS City FROM r WHERE ProviderNumber != ''""")
def load_hospital(spark, sf_dir):
    """A file of hospitals by position, rows without a provider dropped."""
    return _load(spark, sf_dir, "hospital").select("id", "ProviderNumber", "HospitalName", "City")


@query(f"""WITH r AS ({_raw_sql("tax", "fname", "salary", "rate", "child_exemp")})
 SELECT row_number() OVER (ORDER BY c_custkey)::INTEGER AS id, fname, trunc(TRY_CAST(salary AS DOUBLE))::INTEGER AS salary, TRY_CAST(rate AS DOUBLE) AS rate, trunc(TRY_CAST(child_exemp AS DOUBLE))::INTEGER AS child_exemp FROM r""")
def load_tax(spark, sf_dir):
    """A file of taxpayers: null words, numbers cut towards zero."""
    return _load(spark, sf_dir, "tax").select("id", "fname", "salary", F.col("rate").cast("double").alias("rate"), "child_exemp")


@query(f"""WITH r AS ({_raw_sql("flight", "Year", "FlightDate", "Origin", "OriginWac")})
 SELECT row_number() OVER (ORDER BY c_custkey)::INTEGER AS id, Year::INTEGER AS Year, strftime(nullif(FlightDate, '')::DATE, '%Y-%m-%d') AS FlightDate, Origin, OriginWac::INTEGER AS OriginWac FROM r""")
def load_flight(spark, sf_dir):
    """A file of flights, all numbers whole."""
    return _load(spark, sf_dir, "flight").select("id", "Year", F.col("FlightDate").cast("string").alias("FlightDate"), "Origin", "OriginWac")


@query("SELECT d AS dataset, t AS table_name, true AS there, false AS other, count(*) FILTER (CASE d WHEN 'adult' THEN c_custkey % 11 != 0 AND c_custkey % 13 != 0 AND c_custkey % 17 != 0 WHEN 'hospital' THEN c_custkey % 9 != 0 ELSE true END) AS n FROM customer, (VALUES ('adult', 'adult_data'), ('airport', 'airports'), ('hospital', 'hospital_data'), ('tax', 'tax_data'), ('flight', 'flight_data')) v(d, t) GROUP BY ALL")
def populate_tables(spark, sf_dir):
    """All five files loaded into tables, twice; whether the tables are there, and their rows."""
    target = Scratch(spark).root
    files = {name: _file(spark, sf_dir, name) for name in RAW}
    for _ in range(2):
        paths = datasets.populate(spark, files, target)
    out = None
    for name, path in paths.items():
        row = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("dataset"), F.lit(datasets.dataset(name).table).alias("table_name"), F.lit(runs.table_exists(spark, path)).alias("there"), F.lit(runs.table_exists(spark, f"{path}_other")).alias("other"), "n"
        )
        out = row if out is None else out.unionByName(row)
    return out


def _name_sql(column: str) -> str:
    """A value as an attribute's name, as SQL for both engines."""
    return f"lower(replace(substr({column}, 3), ' ', '-'))"


def _literal_sql() -> str:
    """A constraint as a literal, or a comment, from the columns of an order."""
    quoted = lambda text: f"chr(39) || {text} || chr(39)"
    first = f"'t1.' || CASE WHEN o_custkey % 3 = 0 THEN 'area_code' ELSE {_name_sql('o_orderpriority')} END"
    op = "CASE o_orderstatus WHEN 'F' THEN '!=' WHEN 'O' THEN '<=' ELSE '>' END"
    q = lambda word: quoted(f"'{word}'")
    tuples = f"'[(' || {quoted(first)} || ', ' || {q('==')} || ', ' || {q('t2.zip')} || '), (' || {q('t1.state')} || ', ' || {quoted(op)} || ', ' || {q('t2.state')} || ')],'"
    return f"CASE WHEN o_orderkey % 7 = 0 THEN '# ' || o_orderpriority ELSE {tuples} END"


@query(f"""WITH l AS (SELECT o_orderkey, {_name_sql("o_orderpriority")} AS a, o_custkey % 3 = 0 AS tax, o_orderstatus AS s FROM orders WHERE o_orderkey % 7 != 0)
 SELECT o_orderkey, 't0.' || CASE WHEN tax THEN 'AreaCode' ELSE a END || ' == t1.Zip AND t0.State ' || CASE s WHEN 'F' THEN '!=' WHEN 'O' THEN '<=' ELSE '>' END || ' t1.State' AS dc FROM l""")
def dc_parse_literals(spark, sf_dir):
    """Constraints written as literals, with the files' column names: one from each order."""
    lines = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")).select("o_orderkey", F.expr(_literal_sql()).alias("value"))
    preds = constraints.predicates_of_literal(F.col("value"), constraints.TAX_COLUMNS)
    return lines.select("o_orderkey", preds.alias("preds")).filter("preds is not null").select("o_orderkey", constraints.to_text(F.col("preds")).alias("dc"))


@query("""WITH l AS (SELECT c_mktsegment AS source, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS dc_id, c_nationkey AS n, c_custkey % 2 = 0 AS two FROM customer WHERE c_custkey % 5 != 0)
 SELECT 'top' || source || 'DCs' AS source, source AS dataset, dc_id::INTEGER AS dc_id, 't0.n' || n || ' != t1.n' || n || CASE WHEN two THEN ' AND t0.zip == t1.zip' ELSE '' END AS dc FROM l""")
def dc_parse_directory(spark, sf_dir):
    """All constraint files of a folder: one for each market segment, a line for each of its customers."""
    from veilgraph.store import file_system

    root = Scratch(spark).root
    line = F.expr("CASE WHEN c_custkey % 5 = 0 THEN '# none' ELSE 'not (t1.n' || c_nationkey || '<>t2.n' || c_nationkey || CASE WHEN c_custkey % 2 = 0 THEN ' and t1.zip==t2.zip' ELSE '' END || ')' END")
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", line.alias("value"))
    # a catalog is a file, so its lines are one task's work
    rows.repartition("c_mktsegment").sortWithinPartitions("c_mktsegment", "c_custkey").select("c_mktsegment", "value").write.partitionBy("c_mktsegment").text(f"{root}/raw")
    where, system = file_system(spark, f"{root}/files")
    system.mkdirs(where)
    for part in system.globStatus(file_system(spark, f"{root}/raw/*/part-*")[0]):
        name = part.getPath().getParent().getName().split("=")[1]
        system.rename(part.getPath(), file_system(spark, f"{root}/files/top{name}DCs")[0])
    return constraints.parse_directory(spark, f"{root}/files").select("source", "dataset", "dc_id", constraints.to_text(F.col("preds")).alias("dc"))


@query(f"WITH {LINES_SQL} SELECT dataset, dc_id, weight, len(regexp_extract_all(line, 't\\d\\.[\\w\\-]+')) // 2 AS n_preds FROM c")
def catalog_round_trip(spark, sf_dir):
    """The five catalogs, written and read back."""
    path = f"{Scratch(spark).root}/catalog"
    constraints.write_catalog(_constraints(spark, sf_dir), path)
    return constraints.read_catalog(spark, path).select("dataset", "dc_id", "weight", F.size("preds").cast("long").alias("n_preds"))


@query(f"WITH {mined.WEIGHTS_SQL} SELECT ds AS dataset, dc_id::INTEGER AS dc_id, w AS weight FROM z_w")
def weights_by_position(spark, sf_dir):
    """The tables' constraints, each table's read as text, with the mined weight at their position, a surplus weight ignored."""
    weighted = mined.weighted(spark, sf_dir).select("dataset", "dc_id", "weight").collect()  # a row for each constraint
    out = None
    for name, source in mined.SOURCES.items():
        parsed = constraints.parse_text(spark.createDataFrame([(line,) for line in source.lines()], "value string").coalesce(1))
        own = [r.weight for r in sorted((r for r in weighted if r.dataset == name), key=lambda r: r.dc_id)]
        part = constraints.with_weights(parsed, [*own, 9.0]).select(F.lit(name).alias("dataset"), "dc_id", "weight")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {RUNS_SQL} SELECT 'mine' AS method, upper(dataset[1]) || dataset[2:] AS dataset, count(*) AS n, round(avg(total_time * 1000), 6) AS mean_ms, round(avg(leakage), 6) AS mean_leakage, round(avg((mask_size * 10) / 1024.0::DOUBLE), 6) AS mean_kb FROM r WHERE epsilon_m = 0.1 AND L0 = 0.2 GROUP BY ALL""")
def runs_at_point(spark, sf_dir):
    """Run files written and read back: the rows of one point under one label, in ms and kB, with titled datasets."""
    records = runs.standard_runs(_runs(spark, sf_dir).withColumn("memory_overhead_bytes", F.col("mask_size") * 10))
    path = f"{Scratch(spark).root}/runs"
    records.write.option("header", True).csv(path)
    at = runs.titled(runs.labelled(runs.at_point(runs.read_runs(spark, path, private_only=True), 0.1, 0.2), "mine"))
    return at.groupBy("method", "dataset").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("total_time"), 6).alias("mean_ms"), F.round(F.avg("leakage"), 6).alias("mean_leakage"), F.round(F.avg("memory_kb"), 6).alias("mean_kb"))


@query(f"""WITH {RUNS_SQL} SELECT method, dataset, 2 * count(*) AS n, round(sum(total_time) * 2, 6) AS total FROM r WHERE epsilon_m = 0.1 AND L0 = 0.2 GROUP BY ALL""")
def runs_main_extract(spark, sf_dir):
    """Run records appended twice to one table, and the rows of the main point extracted from it."""
    root = Scratch(spark).root
    for _ in range(2):
        runs.append_runs(runs.standard_runs(_runs(spark, sf_dir)), f"{root}/log")
    runs.extract_main(spark.read.parquet(f"{root}/log"), f"{root}/main")
    return spark.read.parquet(f"{root}/main").groupBy("method", "dataset").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("total_time"), 6).alias("total"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 7 ELSE 0 END AS city, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 != 0 THEN o_orderkey % 5 ELSE 0 END AS zip, (o_orderkey % 2 = 0)::INTEGER * 2 AS n_times FROM orders")
def insertion_times(spark, sf_dir):
    """Insertion times looked up by key; a row or a time that is missing counts as 0."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    times = orders.filter(k % 2 == 0).select(k.alias("insertionKey"), (k % 7).alias("city"), F.when(k % 3 != 0, k % 5).alias("zip"))
    of = lambda name: F.coalesce(F.try_element_at("times", F.lit(name)), F.lit(0).cast("long")).alias(name)
    return deletion.with_insertion_times(orders, times, "o_orderkey").select("o_orderkey", of("city"), of("zip"), F.size("times").alias("n_times"))


@query("SELECT c_custkey, c_name AS plain, regexp_replace(c_name || '/x y', '[^A-Za-z0-9_.\\-]+', '_', 'g') AS safe, round(ceil(c_acctbal / 0.2::DOUBLE) * 0.2::DOUBLE, 6) AS upper FROM customer")
def small_functions(spark, sf_dir):
    """Names without a qualifier, names for files, and numbers raised to a step."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", X.without_qualifier(F.concat(F.lit("t1."), "c_name")).alias("plain"), X.safe_file_name(F.concat("c_name", F.lit("/x y"))).alias("safe"), F.round(X.ceil_to(F.col("c_acctbal"), 0.2).cast("double"), 6).alias("upper"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_values(spark, sf_dir):
    """The distinct values of two columns."""
    return table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").distinct()


DD_WEIGHT_SQL = f"""p AS (SELECT * FROM part ORDER BY md5(p_partkey::VARCHAR), p_partkey LIMIT 1000), q AS (SELECT x.p_size AS xs, y.p_size AS ys, x.p_retailprice AS xp, y.p_retailprice AS yp FROM p x JOIN p y ON x.p_partkey < y.p_partkey),
 th AS (SELECT (quantile_cont(abs(xs - ys)::DOUBLE, 0.25) + 0.0::DOUBLE) / 2 AS tl, quantile_cont(abs(xp - yp), 0.25) AS tr FROM q),
 o AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS rn, * FROM part), k AS (SELECT count(*) AS n FROM part),
 s AS (SELECT pair, {_hash_sql("'7'", "'l'", "pair::VARCHAR")} % n AS i, {_hash_sql("'7'", "'r'", "pair::VARCHAR")} % (n - 1) + 1 AS st, n FROM (SELECT unnest(range(0, 2000)) AS pair), k),
 pr AS (SELECT sqrt(((x.p_size - y.p_size)::DOUBLE * (x.p_size - y.p_size)::DOUBLE) + CASE WHEN x.p_brand = y.p_brand THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS dl, sqrt((x.p_retailprice - y.p_retailprice) * (x.p_retailprice - y.p_retailprice)) AS dr FROM s JOIN o x ON x.rn = s.i JOIN o y ON y.rn = (s.i + s.st) % s.n)"""


@query(f"""WITH {DD_WEIGHT_SQL} SELECT 'p_size,p_brand' AS lhs, 'p_retailprice' AS rhs, round(any_value(tl), 6) AS theta_l, round(any_value(tr), 6) AS theta_r, count(*) AS n_pairs, count(*) FILTER (dl <= tl) AS n_close, count(*) FILTER (dl <= tl AND dr <= tr) AS n_both,
 round(coalesce(count(*) FILTER (dl <= tl AND dr <= tr) / nullif(count(*) FILTER (dl <= tl), 0)::DOUBLE, 0), 9) AS weight, coalesce(count(*) FILTER (dl <= tl AND dr <= tr) / nullif(count(*) FILTER (dl <= tl), 0)::DOUBLE, 0) >= 0.9 AS valid FROM pr, th""")
def dd_weight(spark, sf_dir):
    """The weight of a differential dependency over 2000 random pairs, its thresholds inferred."""
    found = dependencies.differential_weight(_parts(spark, sf_dir), "p_partkey", ["p_size", "p_brand"], "p_retailprice")
    return found.select("lhs", "rhs", F.round("theta_l", 6).alias("theta_l"), F.round("theta_r", 6).alias("theta_r"), "n_pairs", "n_close", "n_both", F.round("weight", 9).alias("weight"), "valid")


@query(f"{LEAK_SQL} SELECT ds AS dataset, count(*) AS masks, round(sum(gre), 6) AS total_leakage, 1 AS builds FROM lk GROUP BY ds")
def template_store(spark, sf_dir):
    """Leakage tables kept in a folder: asked for twice, each is built and logged once."""
    model, _, _ = _leakage(spark, sf_dir)
    store = templates.TemplateStore(spark, Scratch(spark).root)
    store.table(model)
    kept = store.table(model).groupBy("dataset").agg(F.count(F.lit(1)).alias("masks"), F.round(F.sum("leakage_greedy"), 6).alias("total_leakage"))
    return kept.join(store.build_times().groupBy("dataset").agg(F.count(F.lit(1)).cast("int").alias("builds")), "dataset")


@query(f"""WITH RECURSIVE {MODEL_SQL}, {MASKS_SQL}
 SELECT ds AS dataset, 'exp' AS method, count(*) * 16 AS memory_overhead_bytes FROM mk GROUP BY ds""")
def overhead_bytes(spark, sf_dir):
    """Bytes that the mechanism over all masks holds for each catalog."""
    model, _, t = _leakage(spark, sf_dir)
    return templates.overheads(model, t).filter("method = 'exp'").drop("target")


@query(f"""WITH {LEAK_SQL.removeprefix("WITH ")}, cl(ds, mask, n, t, k, i) AS ({CLOSE_SQL.split("cl(ds, mask, n, t, k, i) AS (", 1)[1]},
 bs AS (SELECT ds, n, mask, sz FROM sf QUALIFY row_number() OVER (PARTITION BY ds ORDER BY sz, mask) = 1)
 SELECT bs.ds AS dataset, bs.mask, bs.sz AS mask_size, round(gre, 9) AS leakage, (-bs.sz)::DOUBLE - CASE WHEN gre > 0.2 THEN 1000.0::DOUBLE ELSE 0.0::DOUBLE END AS utility, num AS num_chains, bs.n AS zone_size FROM bs JOIN lk ON lk.ds = bs.ds AND lk.mask = bs.mask""")
def min_choice(spark, sf_dir):
    """The smallest mask of each catalog with its leakage and utility."""
    model, scratch, t = _leakage(spark, sf_dir)
    return answers.choose(model, scratch, "min", table=t).select("dataset", "mask", "mask_size", F.round("leakage", 9).alias("leakage"), "utility", "num_chains", F.col("n").alias("zone_size"))


@query()
def request_records(spark, sf_dir):
    """One deletion request by each method for each catalog, with measured times: the run records."""
    model, _, t = _leakage(spark, sf_dir)
    rows = dealt(table(spark, sf_dir, "customer")).withColumns({a: F.col("c_name") for a in {x.lower(): x for d in constraints.DATASETS for x in (*plain_model(d)[0], constraints.TARGETS[d])}.values()})
    out, root = None, Scratch(spark).root
    for name in constraints.DATASETS:
        for method in answers.METHODS:
            own = model.filter(F.col("dataset") == name)
            one = answers.run_request(rows, "c_custkey", 1, own, method, f"{root}/{name}_{method}", seed=7, table=t.filter(F.col("dataset") == name))
            out = one if out is None else out.unionByName(one)
    return _rounded(out, 9)
