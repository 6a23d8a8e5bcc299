"""The registered queries do the whole job: every chain, every catalog, every pair."""

import math
import os
from collections import deque
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from test_leakage import plain_chains
from veilgraph.operators import mechanisms
from veilgraph.plans import driver
from veilgraph.plans import mined
from veilgraph.plans.driver import plain_model
from veilgraph.sources import constraints

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@needs_tables
def test_flagship_draws_from_leakage_over_chains(spark):
    real = {r["mask"]: r.leakage_greedy for r in driver._leakage(spark, ("airport",))[2].collect()}
    rows = E.entry(spark).collect()
    assert rows and all(abs(r.leakage - real[r["mask"]]) < 1e-8 for r in rows)
    assert all(r.leakage <= 0.2 for r in rows)  # masks over the cap weigh exp(-300)


def test_sweep_covers_all_five_catalogs(spark):
    runs = E.queries()["sweep"](spark, SF)
    got = {(r.method, r.dataset): r["count"] for r in runs.groupBy("method", "dataset").count().collect()}
    assert got == {(m, d): 100 if m == "min" else 11_000 for m in ("exp", "gum", "gum_random", "gum_zero", "min") for d in (*constraints.DATASETS, *mined.SOURCES)}


FIVE = ("all_masks", "chain_counts", "leak_greedy", "leak_noisy_or", "leak_max", "leak_by_size", "em_probabilities", "em_expected", "em_sample", "gum_order", "gum_prefixes", "gum_probabilities", "gum_ablation_zero", "gum_ablation_random", "sweep_points")


@needs_tables
@pytest.mark.parametrize("name", FIVE)
def test_queries_on_catalogs_and_tables(spark, name):
    rows = same_as_its_sql(spark, name)
    at = sorted(E.queries()[name](spark, SF).columns).index("dataset")
    assert {r[at] for r in rows} == {*constraints.DATASETS, *mined.SOURCES}


def test_large_catalogs_match_a_plain_search(spark):
    table = driver._leakage(spark, constraints.DATASETS)[2]
    for dataset, masks in (("adult", (0, 5, 1000, 4095)), ("flight", (0, 77, 3000, 8191))):
        rows = {r["mask"]: r for r in table.filter((F.col("dataset") == dataset) & F.col("mask").isin(*masks)).collect()}
        for mask in masks:
            found, left, used = plain_chains(dataset, mask), 1.0, 0
            for w, inferred in sorted(found, key=lambda c: (-c[0], bin(c[1]).count("1"))):
                if not used & inferred:
                    used, left = used | inferred, left * (1 - w)
            assert rows[mask].num_chains == len(found) and abs(rows[mask].leakage_greedy - (1 - left)) < 1e-12


def plain_bound(dataset, mask):
    """The bound by loops over the chains that chains() finds in plain Python, each with its edges."""
    names, edges = plain_model(dataset)
    t = 1 << len(names)
    seen0 = (t - 1) & ~mask
    out = [(e,) for e, m, _ in edges if m & t and m & ~t & mask == 0]
    queue, done = deque((seen0 | m, (e,)) for e, m, _ in edges if not m & t and bin(m & ~seen0).count("1") == 1), set()
    while queue:
        known, path = queue.popleft()
        if known in done:
            continue
        done.add(known)
        for e, m, _ in edges:
            lack = m & ~known
            if bin(lack).count("1") == 1 and bin(m & ~seen0).count("1") > 1:
                if lack == t:
                    out.append((*path, e))
                else:
                    queue.append((known | lack, (*path, e)))
    w = {e: x for e, _, x in edges}
    weigh = lambda used: math.prod(w[e] for e in set(used))
    both = sum(weigh((*a, *b)) for a, b in combinations(out, 2))
    return min(1 - math.prod(1 - weigh(c) for c in out), max(0.0, min(1.0, sum(map(weigh, out)) - both)))


def test_second_order_bound_of_every_mask_of_five_catalogs(spark):
    got = {(r.dataset, r["mask"]): r.leakage for r in E.queries()["leak_ie2"](spark, SF).collect()}
    assert sum(d in constraints.DATASETS for d, _ in got) == 13_384 and {d for d, _ in got} == {*constraints.DATASETS, *mined.SOURCES} and got["tax", 7] == 0
    for dataset, masks in (("airport", range(64)), ("tax", range(8)), ("hospital", range(0, 1024, 37)), ("adult", (0, 9, 100)), ("flight", (0, 3, 8000))):
        assert all(abs(got[dataset, m] - plain_bound(dataset, m)) < 2e-9 for m in masks), dataset


def test_mechanisms_honour_the_second_order_bound(spark):
    model, scratch, table = driver._leakage(spark, ("airport", "tax"))
    want = {(d, m): plain_bound(d, m) for d, n in (("airport", 64), ("tax", 8)) for m in range(n)}
    close = lambda rows: all(abs(r.leakage - want[r.dataset, r["mask"]]) < 1e-9 for r in rows)
    rows = mechanisms.all_mask_candidates(table, model, "nor_with_ie").collect()
    assert len(rows) == 72 and close(rows)
    assert close(mechanisms.prefix_candidates(model, scratch, table, method="nor_with_ie").collect())
    assert close(mechanisms.exponential_mask(model, table, 0.1, 0.2, method="nor_with_ie", seed=1).collect())
    assert close(mechanisms.prefix_mask(model, scratch, 0.1, 0.2, method="nor_with_ie", seed=1).collect())


def duck(name, sf):
    con = pytest.importorskip("duckdb").connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    found = con.execute(E.oracle_sql()[name])
    names = [d[0] for d in found.description]
    return names, found.fetchall()


def same_as_its_sql(spark, name, sf=SF):
    names, want = duck(name, sf)
    plain = lambda v: round(float(v), 6) if type(v).__name__ in ("Decimal", "float") else v
    order = sorted(range(len(names)), key=names.__getitem__)
    want = [tuple(r[i] for i in order) for r in want]
    got = [tuple(map(plain, r)) for r in E.queries()[name](spark, sf).select(*sorted(names)).collect()]
    key = lambda row: [(v is None, str(v)) for v in row]
    assert sorted(got, key=key) == sorted((tuple(map(plain, r)) for r in want), key=key)
    return got


@needs_tables
@pytest.mark.parametrize("name", ["pair_sample", "dc_direction_stats", "dc_best_head", "dc_weights_gamma", "gamma_sweep"])
def test_pair_statistics_on_the_full_sample(spark, name):
    rows = same_as_its_sql(spark, name)
    assert name != "pair_sample" or len(rows) == 300_000


@needs_tables
@pytest.mark.parametrize("name", ["dd_distance", "dd_threshold", "dd_support"])
def test_differential_dependencies_on_the_full_sample(spark, name):
    rows = same_as_its_sql(spark, name, SF.replace("sf0.001", "sf0.01"))  # more than 1000 parts
    assert name != "dd_distance" or len(rows) == 1000 * 999 // 2
