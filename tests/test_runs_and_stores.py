"""Records, stores, sinks and the whole experiment."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from test_whole_job import SF, needs_tables, same_as_its_sql
from veilgraph.operators import answers, dependencies, hypergraph, leakage, report, templates
from veilgraph.plans import source_queries
from veilgraph.plans.whole import run_all
from veilgraph.sources import constraints, datasets, runs
from veilgraph.store import Scratch


@needs_tables
@pytest.mark.parametrize("name", ["load_adult", "load_airport", "load_hospital", "load_tax", "load_flight", "populate_tables", "dc_parse_directory", "runs_at_point", "dd_weight", "min_choice", "min_deletion_by_time", "insertion_time_filter"])
def test_queries_match_their_sql(spark, name):
    same_as_its_sql(spark, name)


@pytest.fixture(scope="module")
def tax(spark):
    return Scratch(spark).put(hypergraph.models(constraints.catalog(spark, ("tax",))), "model")


def test_records_of_single_requests(spark, tax, tmp_path):
    rows = spark.createDataFrame([(1, "c", "z", "s", "a"), (2, "c", "z", "s", "a")], "id int, city string, zip string, state string, area_code string")
    for method in answers.METHODS:
        r = answers.run_request(rows, "id", 1, tax, method, str(tmp_path / method), seed=3).collect()
        assert len(r) == 1
        r = r[0]
        assert (r.method, r.dataset, r.target_attribute, r.num_instantiated_cells) == (method, "tax", "city", 3)
        assert abs(r.total_time - r.init_time - r.model_time - r.del_time) < 1e-9 and min(r.model_time, r.del_time) > 0 and r.memory_overhead_bytes > 0
        assert abs(r.baseline_leakage_empty_mask - 0.5548418449270073) < 1e-9 and (r.epsilon_m is None) == (method == "min")
        kept = {x.id: x for x in spark.read.parquet(str(tmp_path / method)).collect()}
        assert kept[1].city is None and sum(kept[1][c] is None for c in ("zip", "state", "area_code")) == r.mask_size and None not in kept[2]
    with pytest.raises(ValueError):
        answers.choose(tax, Scratch(spark), "other")


def test_templates_are_built_once_and_anew_for_a_new_model(spark, tax, tmp_path):
    store = templates.TemplateStore(spark, str(tmp_path))
    assert store.build_times().count() == 0 and store.sizes(tax) == {("tax", "city"): 0}
    one = store.table(tax).count()
    assert store.table(tax).count() == one == 8 and store.build_times().count() == 1 and store.sizes(tax)["tax", "city"] > 0
    store.table(tax, "nor_with_ie")
    light = hypergraph.models(constraints.catalog(spark, ("tax",)), lightest=0.6)
    assert store.table(light).count() == 4 and store.build_times().count() == 3
    with pytest.raises(leakage.LeakageError):
        store.table(tax, "other")


def test_programs_and_sizes(spark, tax, tmp_path):
    templates.write_program(tax, str(tmp_path / "lp"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "lp")).select("value").collect())
    assert text.startswith("Minimize\n") and text.endswith("End")
    size = templates.program_sizes(tax).first().bytes
    assert size == len(text) + 1
    held = {r.method: r.memory_overhead_bytes for r in templates.overheads(tax, leakage.leakage_table(tax, Scratch(spark))).collect()}
    assert held["min"] == size and held["exp"] == 128 and held["gum"] > 0


def test_malformed_weighted_rows_fail(spark):
    for bad in ("t0.a EQUAL t1.a t1.b", "t0.a LIKE t1.a", "t0.a str x EQUAL t1.a str", "a EQUAL t1.a", ""):
        with pytest.raises(Exception, match="not a predicate"):
            constraints.parse_weighted(spark.createDataFrame([(bad, 0.5)], "dc_str string, weight double")).collect()


def test_differential_weight(spark):
    df = spark.range(60).select(F.col("id").alias("k"), (F.col("id") % 10).alias("x"), ((F.col("id") % 10) * 2.0).alias("y"), F.lit("a").alias("s"))
    r = dependencies.differential_weight(df, "k", ["x"], "y", theta_l=1.0, theta_r=2.0).first()
    assert (r.n_pairs, r.weight, r.valid) == (1770, 1.0, True) and r.n_close == r.n_both > 0
    r = dependencies.differential_weight(df, "k", ["x", "s"], "y").first()
    assert r.theta_l > 0 and r.theta_r == 4 * r.theta_l
    assert dependencies.differential_weight(df, "k", ["x"], "y", theta_l=-1.0).first().weight == 0


def test_the_whole_experiment(spark, tmp_path):
    out = str(tmp_path / "out")
    path = tmp_path / "tax.csv"
    path.write_text(",".join(n for n, _ in datasets._fields(datasets.TAX)) + "\nA,B,M,,1,c,s,z,S,Y,1,3.5,1,1,1\n")
    got = run_all(spark, {"tax": str(path)}, out, names=("tax", "airport"), epsilons=(0.1, 0.5, 1.0), caps=(0.2, 0.3), iterations=5)
    assert got["tables/tax"].count() == 1 and got["runs"].count() == 4 * 2 * 6 * 5 + 10 and got["masks"].count() == 72
    assert {r.method for r in got["main"].select("method").distinct().collect()} == {"exp", "gum", "gum_random", "gum_zero", "min"}
    charts = {n.split("/")[1] for n in got if n.startswith("charts/")}
    assert charts == {"8", "9", "10", "11", "12", "13", "14", "16", "16_curves", "17a", "17b", "17c", "18a", "18b", "18c", "19", "20"}
    shown = spark.read.option("header", True).csv(f"{out}/statistics")
    assert shown.count() == 10 and {"rho", "avg_memory_bytes", "avg_time_ms"} <= set(shown.columns)
    assert runs.table_exists(spark, f"{out}/runs") and not runs.table_exists(spark, f"{out}/none") and not runs.table_exists(spark, "no_such_table")


def test_standard_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, None), ("b", None, None, None)], "method string, init_time double, model_time double, del_time double")
    got = {r.method: r.total_time for r in runs.standard_runs(df.withColumn("extra", F.lit(1))).collect()}
    assert got == {"a": 3.0, "b": None}
    assert "avg_time_ms" not in report.main_metrics(spark.createDataFrame([("a", "tax", 1, 0.5, 3)], "method string, dataset string, mask_size int, leakage double, num_instantiated_cells int")).columns


def test_all_queries_are_registered():
    assert set(source_queries.RAW) == set(constraints.DATASETS) and {f"load_{d}" for d in constraints.DATASETS} <= set(E.queries())
    assert os.path.basename(SF)
