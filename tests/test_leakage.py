"""Golden values of the catalogs, properties of the estimators, mechanisms and deletion."""

import math
import random
import re
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgraph.functions import expressions as X
from veilgraph.operators import deletion, hypergraph, leakage, mechanisms, report
from veilgraph.operators.chain_search import smallest_masks
from veilgraph.operators.sweep import run_sweep
from veilgraph.plans.driver import plain_model
from veilgraph.sources import constraints
from veilgraph.store import Scratch

SMALL = ("airport", "hospital", "tax")
#: Leakage of the empty mask, zone sizes and smallest masks of the catalogs.
EMPTY = {"airport": 0.49830908053361767, "hospital": 0.6623992294064142, "adult": 0.49122554744404323, "flight": 0.9826408586840785, "tax": 0.5548418449270073}
ZONE = {"airport": 6, "hospital": 10, "adult": 12, "flight": 13, "tax": 3}
LEAST = {"airport": 4, "hospital": 9, "adult": 9, "flight": 11, "tax": 3}


@pytest.fixture(scope="module")
def scratch(spark):
    return Scratch(spark)


@pytest.fixture(scope="module")
def model(spark, scratch):
    return scratch.put(hypergraph.models(constraints.catalog(spark)), "model")


@pytest.fixture(scope="module")
def small(spark, scratch):
    return scratch.put(hypergraph.models(constraints.catalog(spark, SMALL)), "small")


@pytest.fixture(scope="module")
def table(small, spark):
    return leakage.leakage_table(small, Scratch(spark))


def test_zones_and_models_agree_with_plain_python(model):
    for r in model.collect():
        names, edges = plain_model(r.dataset)
        assert list(r.names) == names and [(e.eid, e.mask, e.w) for e in r.edges] == edges and r.n == ZONE[r.dataset]


def test_empty_masks_and_smallest_masks(model):
    got = {r.dataset: r.leakage_direct for r in leakage.direct_leakage(model.withColumn("mask", F.lit(0).cast("long"))).collect()}
    assert all(math.isclose(got[d], EMPTY[d], abs_tol=1e-14) for d in EMPTY)
    best = {r.dataset: r for r in mechanisms.minimal_masks(model).collect()}
    assert {d: r.mask_size for d, r in best.items()} == LEAST
    assert {d: r.n_optima for d, r in best.items()} == {"airport": 1, "hospital": 1, "adult": 4, "flight": 1, "tax": 1}
    assert list(best["airport"].names) == ["iso_country", "municipality", "scheduled_service", "type"]


def plain_chains(dataset, mask):
    """All chains of a catalog's mask."""
    names, edges = plain_model(dataset)
    return search(len(names), edges, mask)


def search(n, edges, mask):
    """All chains by a queue over knowledge states, edges in order."""
    t = 1 << n
    seen0 = (t - 1) & ~mask
    out = [(w, 0) for _, m, w in edges if m & t and m & ~t & mask == 0]
    queue = deque((seen0 | (m & ~seen0), w) for _, m, w in edges if not m & t and bin(m & ~seen0).count("1") == 1)
    done = set()
    while queue:
        known, w = queue.popleft()
        if known in done:
            continue
        done.add(known)
        for _, m, we in edges:
            lack = m & ~known
            if bin(lack).count("1") == 1 and bin(m & ~seen0).count("1") > 1:
                if lack == t:
                    out.append((w * we, known & ~seen0))
                else:
                    queue.append((known | lack, w * we))
    return out


@pytest.mark.parametrize("dataset", ["airport", "tax", "hospital"])
def test_estimators_match_a_plain_search(table, dataset):
    rows = {r["mask"]: r for r in table.filter(F.col("dataset") == dataset).collect()}
    assert len(rows) == 1 << ZONE[dataset]
    for mask in list(rows)[:: 1 if dataset != "hospital" else 17]:
        found, r = plain_chains(dataset, mask), rows[mask]
        left, used = 1.0, 0
        for w, inferred in sorted(found, key=lambda c: (-c[0], bin(c[1]).count("1"))):
            if not used & inferred:
                used, left = used | inferred, left * (1 - w)
        assert r.num_chains == len(found)
        assert math.isclose(r.leakage_noisy_or, 1 - math.prod(1 - w for w, _ in found), abs_tol=1e-12)
        assert math.isclose(r.leakage_greedy, 1 - left, abs_tol=1e-12)
        assert math.isclose(r.leakage_max, max((w for w, i in found if not i), default=0.0), abs_tol=1e-12)
        assert r.leakage_max <= r.leakage_greedy + 1e-9 <= r.leakage_noisy_or + 2e-9


def test_tax_masks(table):
    got = {r["mask"]: r.leakage_greedy for r in table.filter("dataset = 'tax'").collect()}  # bits: area_code, state, zip
    want = {0: EMPTY["tax"], 1: EMPTY["tax"], 2: EMPTY["tax"], 3: EMPTY["tax"], 4: 0.3057912208405609, 5: 0.3057912208405609, 6: 0.22900911614700675, 7: 0.0}
    assert all(math.isclose(got[m], want[m], abs_tol=1e-12) for m in want)


def test_second_order_bound(spark, small, table):
    two = small.filter("dataset in ('airport', 'tax')")
    found = leakage.leakage_table(two, Scratch(spark), method="nor_with_ie")
    got = {(r.dataset, r["mask"]): r.leakage_ie for r in found.collect()}
    nor = {(r.dataset, r["mask"]): r.leakage_noisy_or for r in table.collect()}
    assert all(0 <= v <= nor[k] + 1e-12 for k, v in got.items())
    w = [w for _, m, w in plain_model("airport")[1] if m & 64]
    assert math.isclose(got["airport", 0], min(nor["airport", 0], sum(w) - w[0] * w[1]), abs_tol=1e-12)


def test_chains_and_their_edges(small, table):
    rows = leakage.chains(leakage.powerset(small), small, with_edges=True).collect()
    counts = {}
    for r in rows:
        _, edges = plain_model(r.dataset)
        assert math.isclose(r.w, math.prod(edges[e][2] for e in r.edges), abs_tol=1e-12) and r.eid in r.edges and len(r.edges) == r.level + 1
        counts[r.dataset, r["mask"]] = counts.get((r.dataset, r["mask"]), 0) + 1
    assert counts == {(r.dataset, r["mask"]): r.num_chains for r in table.filter("num_chains > 0").collect()}


def test_a_model_of_many_edges(spark):
    """More edges than a long has bits, against a plain search."""
    rng = random.Random(4)
    edges = [(i, sum(1 << b for b in rng.sample(range(6), rng.randint(2, 3))), rng.random()) for i in range(150)]
    many = spark.createDataFrame([("many", "t", list("abcde"), 5, 32, edges)], "dataset string, target string, names array<string>, n int, tbit long, edges array<struct<eid:int,mask:long,w:double>>")
    for r in leakage.leakage_table(many, Scratch(spark), method="nor_with_ie").collect():
        found = search(5, edges, r["mask"])
        assert r.num_chains == len(found) and math.isclose(r.leakage_noisy_or, 1 - math.prod(1 - w for w, _ in found), abs_tol=1e-9) and 0 <= r.leakage_ie <= 1
    with pytest.raises(leakage.LeakageError):
        leakage.leakage_table(many.withColumn("edges", F.transform("edges", lambda e: F.struct(e["eid"].alias("eid"), e["mask"].alias("mask"), (e["w"] + 1).alias("w")))), Scratch(spark))


def test_released_prefixes(small, table, scratch):
    got = {r.step: r.leakage for r in mechanisms.prefix_candidates(small, scratch, table).filter("dataset = 'airport'").collect()}
    for size, want in {2: 0.12466526184245019, 3: 0.024793890495394266, 4: 0.024793890495394266, 6: 0.0}.items():
        assert math.isclose(got[size], want, abs_tol=1e-12)


def test_prefix_leakage_without_a_table(small, table, scratch):
    one = mechanisms.prefix_candidates(small, scratch, table).select("dataset", "step", "mask", "leakage").collect()
    two = mechanisms.prefix_candidates(small, scratch).select("dataset", "step", "mask", "leakage").collect()
    assert sorted(one) == sorted(two)


def test_probabilities_and_expectation(spark, small, table, scratch):
    p = mechanisms.probabilities(mechanisms.all_mask_candidates(table, small), mechanisms.points(spark, [0.1, 1.0], [0.2]))
    assert all(math.isclose(r.s, 1.0, abs_tol=1e-9) for r in p.groupBy(*mechanisms.POINT).agg(F.sum("p").alias("s")).collect())
    gum = mechanisms.probabilities(mechanisms.prefix_candidates(small, scratch, table), mechanisms.points(spark, [0.1], [0.2]))
    assert math.isclose(mechanisms.expected(gum).filter("dataset = 'airport'").first().e_mask, 3.4222113, abs_tol=1e-6)


def test_draws_follow_the_distribution(spark, small, table):
    p = mechanisms.probabilities(mechanisms.all_mask_candidates(table, small), mechanisms.points(spark, [0.1], [0.2]))
    draws = mechanisms.draw(p, 3000, seed=1)
    got = {r.dataset: (r.m, r.n) for r in draws.groupBy("dataset").agg(F.avg("mask_size").alias("m"), F.count(F.lit(1)).alias("n")).collect()}
    for r in mechanisms.expected(p).collect():
        assert got[r.dataset][1] == 3000 and abs(got[r.dataset][0] - r.e_mask) < 0.12
    assert draws.filter("p < 1e-9").count() == 0
    again = mechanisms.draw(p, 3000, seed=1)
    assert sorted((r.dataset, r.iteration, r["mask"]) for r in draws.collect()) == sorted((r.dataset, r.iteration, r["mask"]) for r in again.collect())
    assert mechanisms.exponential_mask(small, table, 0.1, 0.2, seed=3).count() == 3
    assert mechanisms.draw(p, 2).count() == 6


def test_draws_in_parts_are_the_same(spark, small, table, monkeypatch):
    p = mechanisms.probabilities(mechanisms.all_mask_candidates(table, small), mechanisms.points(spark, [0.1], [0.2]))
    rows = lambda: sorted((r.dataset, r.iteration, r["mask"]) for r in mechanisms.draw(p, 700, seed=2).collect())
    whole = rows()
    monkeypatch.setattr(mechanisms, "DRAWS_EACH", 64)
    assert rows() == whole and len(whole) == 2100
    asked = spark.range(500).select(F.col("id").alias("k"), F.lit("hospital").alias("dataset"), F.lit("ProviderNumber").alias("target"))
    got = mechanisms.draw_for(asked, p, "k", seed=3).collect()
    want = mechanisms.expected(p).filter("dataset = 'hospital'").first().e_mask
    assert sorted(r.k for r in got) == list(range(500)) and abs(sum(r.mask_size for r in got) / 500 - want) < 0.3


def test_smallest_masks_by_time(spark, small):
    times = spark.createDataFrame([("tax", 1, {"city": 5, "zip": 5}), ("tax", 2, {}), ("tax", 3, {"city": 5, "zip": 4})], "dataset string, key int, times map<string,bigint>")
    got = {r.key: (r.mask_size, list(r.names)) for r in mechanisms.minimal_masks(hypergraph.time_filtered(small, times)).collect()}
    assert got == {1: (1, ["zip"]), 2: (3, ["area_code", "state", "zip"]), 3: (0, [])}


def test_softmax_of_infinite_scores_is_uniform(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, 2.0), (2, 1.0), (2, 1.0)], "g int, s double")
    got = sorted((r.g, r.p) for r in df.withColumn("p", X.softmax(F.col("s"), "g")).collect())
    assert got == [(1, 0.5), (1, 0.5), (2, 0.5), (2, 0.5)]


def test_errors(spark, small):
    with pytest.raises(leakage.LeakageError):
        leakage.method_column("other")
    with pytest.raises(leakage.LeakageError):
        leakage.powerset(small.withColumn("n", F.lit(25)))
    with pytest.raises(ValueError):
        mechanisms.prefix_masks(small, None, "other")


def test_tau_keeps_light_edges(spark):
    light = hypergraph.models(constraints.catalog(spark, ("tax",)), lightest=0.6).first()
    assert list(light.names) == ["state", "zip"] and len(light.edges) == 2


def test_program(model):
    lines = [r.line for r in mechanisms.program_lines(model.filter("dataset = 'tax'")).orderBy("line_no").collect()]
    assert lines[0] == "Minimize" and lines[1] == "  a0 + a1 + a2 + a3" and " target_not_inferable: r0 = 0" in lines and " a0 = 1" in lines
    counts = mechanisms.program_lines(model).filter("line like ' closure_%'").groupBy("dataset").count().collect()
    assert {r.dataset: r["count"] for r in counts} == {"airport": 17, "hospital": 65, "adult": 127, "flight": 173, "tax": 6}
    for line in lines:
        if line.startswith(" closure"):
            head, right = re.match(r" closure_e\d+_h\d+: (.*) >= (-?\d+)", line).groups()
            assert int(right) == 2 - len(re.findall(r"r\d+", head))


def test_time_filter(spark, small):
    times = spark.createDataFrame([("tax", 1, {"city": 5, "zip": 5}), ("tax", 2, {}), ("tax", 3, {"city": 5, "zip": 4})], "dataset string, key int, times map<string,bigint>")
    got = {r.key: [e.mask for e in r.edges] for r in hypergraph.time_filtered(small, times).collect()}
    assert got == {1: [8 | 4], 2: [8 | 4, 1 | 2, 2 | 4], 3: []}


def test_deletion(spark, small):
    rows = spark.createDataFrame([(1, "a", 2), (2, "b", 3), (None, "c", 4)], "id int, City string, zip int")
    ask = spark.createDataFrame([(1, ["city", "no"]), (1, ["ZIP"]), (2, []), (9, ["city"])], "id int, names array<string>")
    assert sorted(map(str, deletion.mask_to_null(rows, ask, "id").collect())) == sorted(map(str, [type(rows.first())(id=1, City=None, zip=None), type(rows.first())(id=2, City="b", zip=3), type(rows.first())(id=None, City="c", zip=4)]))
    masks = spark.createDataFrame([(1, "tax", "city", 5)], "id int, dataset string, target string, mask long")
    assert list(deletion.requests_from_masks(masks, small, "id").first().names) == ["area_code", "zip", "city"]
    assert deletion.random_key(rows.filter("id is not null"), "id", 1).count() == 1
    with deletion.working_copy(rows, "copy") as copy:
        assert copy.count() == 3
    got = deletion.with_insertion_times(ask.limit(1), spark.createDataFrame([(1, 7)], "insertionKey int, city int"), "id").first()
    assert got.times == {"city": 7} and deletion.with_insertion_times(ask, None, "id").first().times == {}


def test_sweep_and_reports(spark, small, table, scratch):
    runs = scratch.put(run_sweep(small, table, scratch, epsilons=(0.1, 1.0), caps=(0.2, 0.3), iterations=20, orderings=mechanisms.ORDERINGS), "runs")
    assert {r.method: r["count"] for r in runs.groupBy("method").count().collect()} == {"exp": 240, "gum": 240, "gum_random": 240, "gum_zero": 240, "min": 60}
    assert runs.filter("method != 'min' and leakage > L0 and p is not null" if "p" in runs.columns else "method = 'exp' and leakage > L0").count() == 0
    figures = report.figures(runs, leakage.all_masks(table, small))
    assert all(f.count() >= 0 for f in figures.values())
    least = {r.dataset: r.avg_mask_size for r in report.main_metrics(runs.filter("method = 'min'")).collect()}
    assert least == {d: LEAST[d] for d in SMALL}


def test_shares(spark):
    got = spark.range(1).select(*[X.budget_share(F.lit(e), F.lit(c)) for e, c in ((0.1, 0.2), (1.0, 0.2), (2.0, 0.5))], X.cap_of_share(X.budget_share(F.lit(0.7), F.lit(0.3)), F.lit(0.7))).first()
    assert all(math.isclose(a, b, abs_tol=1e-11) for a, b in zip(got, (0.216480689052, 0.404609675192, 0.880797077978, 0.3), strict=True))


def test_small_expressions(spark):
    got = spark.range(1).select(X.without_qualifier(F.lit("t1.x")), X.plain_name(F.lit("A-b")), X.safe_file_name(F.lit("a/b c")), X.gamma_tag(F.lit(0.25)), X.ceil_to(F.lit(0.41), 0.2)).first()
    assert got[:4] == ("x", "a_b", "a_b_c", "0p25") and math.isclose(got[4], 0.6)


def test_interpolation_and_smoothing(spark):
    known = spark.createDataFrame([("a", 0.0, 0.0), ("a", 1.0, 2.0), ("b", 0.0, 5.0)], "c string, x double, y double")
    wanted = spark.createDataFrame([("a", 0.25), ("a", -1.0), ("a", 3.0), ("b", 0.5)], "c string, x double")
    got = sorted(tuple(r) for r in report.interpolated(known, wanted, "x", "y", "c").collect())
    assert got == [("a", -1.0, 0.0), ("a", 0.25, 0.5), ("a", 3.0, 2.0), ("b", 0.5, 5.0)]
    assert report.smoothed(known, "x", "y", "c", places=7).count() == 14
    assert math.isclose(report.axis_limit(known, "y").first().upper, 5.0)


def test_stream_of_requests(spark, small, table, scratch, tmp_path):
    from veilgraph.streaming.requests import answer_stream

    rows = spark.createDataFrame([(i, "c", "z", "s", "a") for i in range(6)], "id long, city string, zip string, state string, area_code string")
    asked = str(tmp_path / "asked")
    spark.createDataFrame([(1, "tax", "city"), (3, "tax", "city"), (3, "tax", "city")], "id long, dataset string, target string").write.json(asked)
    stream = spark.readStream.schema("id long, dataset string, target string").json(asked)
    chosen = mechanisms.probabilities(mechanisms.all_mask_candidates(table, small), mechanisms.points(spark, [0.1], [0.2]))
    query = answer_stream(stream, rows, chosen, small, "id", str(tmp_path / "out"), str(tmp_path / "check"), seed=5)
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.id for r in got) == [1, 3] and all(r.city is None and r.zip is None for r in got)


def plain_smallest(n, edges):
    """The smallest safe masks of a zone, all of them tried."""
    t = 1 << n

    def reached(known):
        while True:
            before = known
            for e in edges:
                lack = e & ~known
                if lack and lack & (lack - 1) == 0:
                    known |= lack
            if known == before:
                return known & t

    for size in range(n + 1):
        safe = [m for m in range(t) if m.bit_count() == size and not reached(~m & (t - 1))]
        if safe:
            return size, safe


def test_smallest_masks_from_conflicts_match_all_masks():
    rng = np.random.default_rng(3)
    for _ in range(150):
        n = int(rng.integers(1, 9))
        edges = [int(sum(1 << int(i) for i in rng.choice(n + 1, rng.integers(2, min(4, n + 1) + 1), replace=False))) for _ in range(rng.integers(0, 12))]
        size, masks, safe = smallest_masks(1 << n, np.array(edges, np.int64), 10**9)
        assert safe and (size, sorted(masks.tolist())) == plain_smallest(n, edges)


def grouped_zone(groups, others):
    """Groups of two cells that infer a middle cell, which infers the target; a path of other cells that leads to cell 0."""
    n = 3 * groups + others
    edges = [e for g in range(groups) for e in (1 << g | 1 << (groups + g) | 1 << (2 * groups + g), 1 << (2 * groups + g) | 1 << n)]
    path = [0, *range(3 * groups, n)]
    return n, edges + [1 << a | 1 << b for a, b in zip(path, path[1:])]


def test_a_zone_of_forty_attributes(spark, monkeypatch):
    cases = {"wide": (6, 22), "narrow": (3, 2), "sixty": (2, 54)}
    rows = []
    for name, (groups, others) in cases.items():
        n, edges = grouped_zone(groups, others)
        rows.append((name, "t", [f"a{i:02}" for i in range(n)], n, 1 << n, [(i, m, 0.5) for i, m in enumerate(edges)]))
    model = spark.createDataFrame(rows, "dataset string, target string, names array<string>, n int, tbit long, edges array<struct<eid: int, mask: long, w: double>>")
    for frontier in (20_000, 3):
        monkeypatch.setattr(mechanisms, "FRONTIER", frontier)
        found = {r.dataset: (r["mask"], r.mask_size, r.n_optima) for r in mechanisms.minimal_masks(model).collect()}
        size, masks = plain_smallest(*grouped_zone(3, 2))
        assert found["narrow"] == (min(masks), size, len(masks))
        for name, (groups, _) in cases.items():
            # every middle cell goes and one of its group with it; not cell 0, which its path infers anew
            assert found[name][1:] == (2 * groups, 2 ** (groups - 1))
            assert all(found[name][0] >> (2 * groups + g) & 1 for g in range(groups)) and not found[name][0] & 1


def test_gumbel_draws_follow_the_same_law(spark, small, table):
    at = mechanisms.points(spark, [0.5], [0.3])
    chosen = mechanisms.probabilities(mechanisms.all_mask_candidates(table, small), at).filter("dataset = 'airport'").cache()
    p = {r["mask"]: r.p for r in chosen.collect()}
    drawn = [r["mask"] for r in mechanisms.gumbel_draw(chosen, 4000, seed=5).collect()]
    assert len(drawn) == 4000 and set(drawn) <= set(p)
    seen = {m: drawn.count(m) for m in p}
    likely = [m for m in p if 4000 * p[m] >= 5]
    statistic = sum((seen[m] - 4000 * p[m]) ** 2 / (4000 * p[m]) for m in likely)
    assert statistic < len(likely) + 6 * (2 * len(likely)) ** 0.5
    again = [r["mask"] for r in mechanisms.gumbel_draw(chosen.repartition(7), 4000, seed=5).orderBy("iteration").collect()]
    assert sorted(again) == sorted(drawn)
    chosen.unpersist()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 14])
def test_splines_match_a_dense_solve(n):
    """All coefficients of all pieces at once: values, two derivatives at inner points, and the third at the first and last inner ones."""
    rng = np.random.default_rng(n)
    x, y = np.cumsum(rng.uniform(0.2, 2, n)), rng.normal(0, 5, n)
    at = np.linspace(x[0] - 1, x[-1] + 1, 50)
    got = report.spline_values(x, y, at)
    assert np.allclose(report.spline_values(x, y, x), y)
    if n < 4:
        want = np.linalg.solve(np.vander(x, n), y)
        assert np.allclose(got, np.polyval(want, at))
        return
    m = n - 1
    rows, right = [], []

    def put(piece, values, target=0.0, other=None, others=None):
        row = np.zeros(4 * m)
        row[4 * piece : 4 * piece + 4] = values
        if other is not None:
            row[4 * other : 4 * other + 4] -= others
        rows.append(row)
        right.append(target)

    powers = lambda t, d: [np.polyval(np.polyder(np.eye(4)[3 - k], d), t) if d else t**k for k in range(4)]
    for i in range(m):
        put(i, powers(0.0, 0), y[i])
        put(i, powers(x[i + 1] - x[i], 0), y[i + 1])
    for i in range(m - 1):
        for d in (1, 2, 3) if i in (0, m - 2) else (1, 2):
            put(i, powers(x[i + 1] - x[i], d), 0.0, i + 1, powers(0.0, d))
    coefficients = np.linalg.lstsq(np.array(rows), np.array(right), rcond=None)[0].reshape(m, 4)
    piece = np.clip(np.searchsorted(x, at, "right") - 1, 0, m - 1)
    want = [sum(c * (t - x[i]) ** k for k, c in enumerate(coefficients[i])) for i, t in zip(piece, at)]
    assert np.allclose(got, want, atol=1e-6)


def test_smoothed_curves_are_clipped(spark):
    rows = [("a", 0, 0.0), ("a", 1, 100.0), ("a", 2, 100.0), ("a", 3, 0.0), ("a", 3, 10.0), ("a", None, 5.0), ("a", 4, None), ("b", 2, 7.0), (None, 1, 1.0), (None, 2, 3.0)]
    found = report.smoothed(spark.createDataFrame(rows, "c string, x int, y double"), "x", "y", "c", places=31, low=0.0, high=100.0).collect()
    of = lambda c: [(r.x, r.y) for r in found if r.c == c]
    assert len(found) == 93 and max(y for _, y in of("a")) == 100.0 and of("a")[-1] == (3.0, pytest.approx(5.0))
    assert {y for _, y in of("b")} == {7.0} and of(None)[0] == (0.0, 0.0)
