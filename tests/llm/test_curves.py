import numpy as np
from pyspark.sql import functions as F

from veilgraph.llm.curve_ann import hilbert_keys, nearest


def test_neighbours_on_the_curve_are_neighbours_in_space():
    grid = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    keys = hilbert_keys(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def brute(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(x for x in v)]
    out = {}
    for i, v in good:
        if i % 5 == 0:
            out[i] = sorted(((-(v @ w), j) for j, w in good if j != i))[:k]
    return out


def test_against_all_products(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(8) * rng.uniform(0.2, 3)).astype(np.float32).tolist()) for i in range(600)]
    same = rows[7][1]
    rows += [(600 + i, same) for i in range(90)]
    rows += [(1000, None), (1005, [0.0] * 8), (1010, [float("nan")] + [1.0] * 7), (1015, [1.0] * 7 + [None]), (1020, [float("inf")] * 8), (1025, [1.0, 2.0]), (None, same), (1030, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cid", F.lit("clash")).repartition(3)
    got = {}
    for r in nearest(df, F.col("vec_id") % 5 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(rows, 20)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(f[1] != q for f in found)
        keys = [(-s, j) for _, j, s in found]
        assert keys == sorted(keys)
        hits += len({j for _, j in want[q]} & {f[1] for f in found})
    assert hits >= 0.95 * 20 * len(want)


def test_fewer_than_k_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id, r.score) for r in nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, 2, 1.0), (2, 1, 0.5)]
    assert nearest(df.limit(0), F.lit(True)).count() == 0
    assert nearest(df, F.lit(False)).count() == 0


def by_rows(rows, k, asks):
    """(query_id, rank, vec_id, score) of every query row against all other rows of its length."""
    out = []
    for n, (i, v) in enumerate(rows):
        if asks(i):
            found = sorted((-sum(float(a) * float(b) for a, b in zip(v, w, strict=True)), j) for m, (j, w) in enumerate(rows) if m != n and len(w) == len(v))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def test_repeated_ids_copies_ties_and_lengths(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(1, 120)]  # many equal products
    rows = [r for r in rows if any(r[1])]
    rows += [(20, [1.0, 0.0, 2.0, 1.0]), (20, [0.5, 1.0, 0.0, 1.0]), (20, [0.5, 1.0, 0.0, 1.0]), (7, [0.5, 1.0, 0.0, 1.0]), (40, [1.0, 0.0, 2.0, 1.0])]
    rows += [(60, [1.0, 2.0]), (61, [3.0, 1.0]), (80, [1.0, 1.0])]  # another length
    rows += [(1, rows[0][1])] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(df, F.col("vec_id") % 20 == 0, k=6).collect())
    assert got == by_rows(rows, 6, lambda i: i % 20 == 0)


def test_scores_do_not_depend_on_the_block(spark):
    from veilgraph.llm.curve_ann import _best

    rng = np.random.default_rng(9)
    x, y = rng.standard_normal((5, 33)), rng.standard_normal((700, 33))
    least = np.arange(700)
    q, v, score = _best(x, y, least, 9)
    parts = []
    for at in range(0, 700, 90):
        a, b, c = _best(x, y[at : at + 90], least[at : at + 90], 9)
        parts += zip(a.tolist(), (-c).tolist(), (b + at).tolist(), strict=True)
    for i in range(5):
        assert [(s, j) for s, j in zip((-score[q == i]).tolist(), v[q == i].tolist(), strict=True)] == [(s, j) for _, s, j in sorted(p for p in parts if p[0] == i)[:9]]
