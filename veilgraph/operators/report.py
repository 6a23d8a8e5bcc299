"""Statistics over run records: confidence intervals, improvements, curves, trade-offs and pivots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.functions.expressions import budget_share, ceil_to

#: The smallest masks that improvements are measured against.
MIN_MASK = {"airport": 5, "hospital": 9, "adult": 9, "flight": 11, "tax": 3}
HALF_WIDTH = 1.96


def min_mask_of(dataset: Column, sizes: dict[str, int] | None = None) -> Column:
    """A dataset's smallest mask size."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in (sizes or MIN_MASK).items() for x in pair]), dataset)


def _ci(column: str) -> Column:
    return HALF_WIDTH * F.coalesce(F.stddev_samp(column), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)))


def curves(runs: DataFrame, sizes: dict[str, int] | None = None) -> DataFrame:
    """By method, dataset, budget and cap: means with 95 % half widths (0 for a single run), and the absolute improvement in percent over the smallest mask."""
    out = (
        runs.filter("epsilon_m != 0")
        .groupBy("method", "dataset", "epsilon_m", "L0")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("mask_size").alias("mean_mask"), _ci("mask_size").alias("ci_mask"), F.avg("leakage").alias("mean_leakage"), _ci("leakage").alias("ci_leakage"))
    )
    least = min_mask_of(F.col("dataset"), sizes)
    return out.withColumns({"improvement": 100 * F.abs(least - F.col("mean_mask")) / least, "ci_improvement": 100 * F.col("ci_mask") / least})


def signed_improvement(runs: DataFrame, sizes: dict[str, int] | None = None) -> DataFrame:
    """By method, dataset, budget and cap: the mean of 100 (min - mask) / min over runs."""
    least = min_mask_of(F.col("dataset"), sizes)
    return runs.groupBy("dataset", "method", "epsilon_m", "L0").agg(F.avg(100 * (least - F.col("mask_size")) / least).alias("improvement"))


def pareto(runs: DataFrame, epsilons: tuple[float, ...] = (0.1, 1.0), sizes: dict[str, int] | None = None) -> DataFrame:
    """Mean mask and leakage by cap at some budgets, and the mask relative to the smallest."""
    out = runs.filter(F.round("epsilon_m", 5).isin(*epsilons)).groupBy("method", "dataset", "epsilon_m", "L0").agg(F.avg("mask_size").alias("mean_mask"), F.avg("leakage").alias("mean_leakage"))
    return out.withColumn("relative_size", F.col("mean_mask") / min_mask_of(F.col("dataset"), sizes))


def runtime_breakdown(runs: DataFrame, methods: tuple[str, ...] = ("min", "exp", "gum")) -> DataFrame:
    """Mean phase times in ms by method, in the given order; a method without runs shows 0."""
    listed = runs.sparkSession.createDataFrame(list(enumerate(methods)), "position int, method string")
    phases = ("init_time", "model_time", "del_time", "total_time")
    means = runs.groupBy("method").agg(*[(F.avg(c) * 1000).alias(c) for c in phases])
    return listed.join(means, "method", "left").select("position", "method", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in phases])


def main_metrics(runs: DataFrame, sizes: dict[str, int] | None = None, *, density: DataFrame | None = None) -> DataFrame:
    """By method and dataset: mask, leakage with half width, deletion ratio, efficiency mean((1 - L) / (mask + 1)), improvement over the smallest mask;
    mean time in ms and mean bytes where the runs have them, and rho where ``density`` (dataset, rho1) is given."""
    more = [(F.avg(c) * scale).alias(name) for c, scale, name in (("total_time", 1000, "avg_time_ms"), ("memory_overhead_bytes", 1, "avg_memory_bytes")) if c in runs.columns]
    out = runs.groupBy("method", "dataset").agg(
        F.avg("mask_size").alias("avg_mask_size"),
        F.avg("leakage").alias("avg_leakage"),
        _ci("leakage").alias("leakage_ci_margin_95"),
        F.avg(F.col("mask_size") / F.col("num_instantiated_cells")).alias("avg_deletion_ratio"),
        F.avg((1 - F.col("leakage")) / (F.col("mask_size") + 1)).alias("avg_efficiency"),
        *more,
    )
    least = min_mask_of(F.col("dataset"), sizes)
    out = out.withColumn("mask_improvement_percent", F.when(F.col("method") == "min", 0.0).otherwise(100 * F.abs(least - F.col("avg_mask_size")) / least))
    return out if density is None else out.join(F.broadcast(density.select("dataset", F.col("rho1").alias("rho"))), "dataset", "left")  # a row for each dataset


def leakage_by_size(masks: DataFrame) -> DataFrame:
    """By dataset and mask size: mean and deviation of three estimators in percent (0 for a single mask)."""
    cols = [f"leakage_{k}" for k in ("noisy_or", "greedy", "max")]
    return masks.groupBy("dataset", "mask_size").agg(
        F.count(F.lit(1)).alias("n"), *[(100 * F.avg(c)).alias(f"mean_{c}") for c in cols], *[(100 * F.coalesce(F.stddev_samp(c), F.lit(0.0))).alias(f"std_{c}") for c in cols]
    )


def heatmap(improvements: DataFrame, epsilons: list[float], value: str = "improvement", drop_last: bool = True) -> DataFrame:
    """Caps down, budgets across; the last cap is dropped."""
    out = improvements.groupBy("L0").pivot("epsilon_m", epsilons).agg(F.avg(value))
    out = out.toDF("L0", *[f"eps_{str(e).replace('.', '_')}" for e in epsilons])
    if drop_last:
        out = out.join(F.broadcast(improvements.agg(F.max("L0").alias("__last"))), F.col("L0") < F.col("__last")).drop("__last")  # one row
    return out


def tau_extremes(improvements: DataFrame, taus: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8), width: float = 0.04) -> DataFrame:
    """By dataset, method and certainty tau: the best and worst improvement among points whose tau lies within ``width``."""
    rows = improvements.withColumn("tau", budget_share(F.col("epsilon_m"), F.col("L0")))
    near = rows.withColumn("tau0", F.explode(F.array(*[F.lit(float(t)) for t in taus]))).filter(F.abs(F.col("tau") - F.col("tau0")) <= width)
    return near.groupBy("dataset", "method", "tau0").agg(F.max("improvement").alias("best"), F.min("improvement").alias("worst"), F.count(F.lit(1)).alias("n"))


def interpolated(points: DataFrame, wanted: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Values of a piecewise linear curve at wanted places; outside the curve, its end's value.

    ``points`` and ``wanted`` are merged in one sorted window for each curve.
    """
    both = points.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.lit(True).alias("given")).unionByName(
        wanted.select(*by, F.col(x).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(False).alias("given"))
    )
    order = Window.partitionBy(*by).orderBy("x", F.desc("given"))
    spot = F.when(F.col("given"), F.struct("x", "y"))
    rows = both.withColumns(
        {"a": F.last(spot, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "b": F.first(spot, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))}
    ).filter("not given")
    share = F.when(F.col("b.x") > F.col("a.x"), (F.col("x") - F.col("a.x")) / F.when(F.col("b.x") > F.col("a.x"), F.col("b.x") - F.col("a.x"))).otherwise(0.0)
    value = F.coalesce(F.col("a.y") + share * (F.col("b.y") - F.col("a.y")), F.col("a.y"), F.col("b.y"))
    return rows.select(*by, F.col("x").alias(x), value.alias(y))


def spline_values(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A curve through points (x rising) at some places: cubic between them, with one cubic over the first two and over the last two pieces.

    Three points make a parabola, two a line, one a constant; beyond the ends the outer pieces go on. The second derivatives solve a
    system of three bands.
    """
    n = len(x)
    if n < 4:
        return np.polyval(np.polyfit(x - x[0], y, n - 1), at - x[0])
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    low, mid, high, right = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), 6 * np.diff(slope)
    # the ends' second derivatives in terms of their neighbours'
    mid[0] += h[0] * (1 + h[0] / h[1])
    high[0] -= h[0] * h[0] / h[1]
    mid[-1] += h[-1] * (1 + h[-1] / h[-2])
    low[-1] -= h[-1] * h[-1] / h[-2]
    for i in range(1, n - 2):
        share = low[i] / mid[i - 1]
        mid[i] -= share * high[i - 1]
        right[i] -= share * right[i - 1]
    second = np.empty(n)
    second[n - 2] = right[-1] / mid[-1]
    for i in range(n - 4, -1, -1):
        second[i + 1] = (right[i] - high[i] * second[i + 2]) / mid[i]
    second[0] = second[1] - h[0] / h[1] * (second[2] - second[1])
    second[-1] = second[-2] + h[-1] / h[-2] * (second[-2] - second[-3])
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    a, b = at - x[k], x[k + 1] - at
    return (second[k] * b**3 + second[k + 1] * a**3) / (6 * h[k]) + (y[k] / h[k] - second[k] * h[k] / 6) * b + (y[k + 1] / h[k] - second[k + 1] * h[k] / 6) * a


def smoothed(points: DataFrame, x: str, y: str, *by: str, places: int = 300, start: float | None = 0.0, low: float | None = None, high: float | None = None) -> DataFrame:
    """(by..., x, y): each curve through its points, at ``places`` places from ``start`` (null: its first point) to its last point, kept within low and high.

    Points of one place are averaged; those without a place or value are left out. A curve is drawn from as many points as masks have sizes, and is
    one task's work.
    """
    kept = points.select(*by, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).dropna(subset=[x, y]).groupBy(*by, x).agg(F.avg(y).alias(y))

    def draw(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column(x).to_numpy())
        own_x, own_y = rows.column(x).to_numpy()[order], rows.column(y).to_numpy()[order]
        at = np.linspace(own_x[0] if start is None else start, own_x[-1], places)
        found = np.clip(spline_values(own_x, own_y, at), low, high) if low is not None or high is not None else spline_values(own_x, own_y, at)
        lead = [rows.column(c).combine_chunks().take(pa.array(np.zeros(places, np.int64))) for c in by]
        return pa.table([*lead, at, found], names=[*by, x, y])

    return kept.groupBy(*by).applyInArrow(draw, kept.schema)


def axis_limit(values: DataFrame, column: str, step: float = 0.2) -> DataFrame:
    """The largest value, rounded up to a step."""
    return values.agg(ceil_to(F.max(column), step).cast("double").alias("upper"))


#: The datasets of the short charts.
SHORT = ("airport", "hospital", "adult")


def figures(runs: DataFrame, masks: DataFrame) -> dict[str, DataFrame]:
    """The tables that the sixteen charts are drawn from, by the charts' numbers. Runs without times have no runtime chart (10)."""
    private = runs.filter("epsilon_m is not null")
    curve, signed = curves(private), signed_improvement(private)
    epsilons = [round(0.1 * i, 1) for i in range(1, 11)]
    of = lambda df, method: df.filter(F.col("method") == method)
    short = lambda df: df.filter(F.col("dataset").isin(*SHORT))
    leaks = lambda method: of(curve, method).select("dataset", "epsilon_m", "L0", "mean_leakage", "ci_leakage")
    reduced = lambda method: of(curve, method).select("dataset", "epsilon_m", "L0", "improvement", "ci_improvement")

    def grids(df: DataFrame) -> DataFrame:
        """Caps down and budgets across for each method and dataset; the last cap is dropped."""
        out = df.groupBy("method", "dataset", "L0").pivot("epsilon_m", epsilons).agg(F.avg("improvement"))
        out = out.toDF("method", "dataset", "L0", *[f"eps_{str(e).replace('.', '_')}" for e in epsilons])
        return out.join(F.broadcast(df.agg(F.max("L0").alias("__last"))), F.col("L0") < F.col("__last")).drop("__last")  # one row

    two = signed.filter(F.col("method").isin("exp", "gum"))
    out = {
        "8": short(curve.filter(F.col("method").isin("exp", "gum"))),
        "9": short(pareto(private.filter(F.col("method").isin("exp", "gum")))),
        "11": grids(short(two)),
        "12": of(curve, "exp"),
        "13": of(curve, "gum"),
        "14": pareto(private.filter(F.col("method").isin("exp", "gum"))),
        "16": leakage_by_size(masks),
        "16_curves": smoothed(leakage_by_size(masks), "mask_size", "mean_leakage_greedy", "dataset", low=0.0, high=100.0),
        "17a": leaks("gum"), "17b": leaks("gum_random"), "17c": leaks("gum_zero"),
        "18a": reduced("gum"), "18b": reduced("gum_random"), "18c": reduced("gum_zero"),
        "19": grids(two),
        "20": tau_extremes(two),
    }
    return out | ({"10": runtime_breakdown(runs)} if "total_time" in runs.columns else {})
