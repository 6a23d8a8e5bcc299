"""Experiments as queries: every budget, cap and repetition of every method in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.operators.mechanisms import all_mask_candidates, draw, minimal_masks, points, prefix_candidates, probabilities
from veilgraph.store import Scratch

#: Budgets, caps and repetitions of the full sweep.
EPSILONS = tuple(round(0.1 * i, 1) for i in range(1, 11))
CAPS = tuple(round(0.1 * i, 1) for i in range(11))
ITERATIONS = 100


def _records(draws: DataFrame, method: str, baseline: DataFrame, penalty: float) -> DataFrame:
    base = F.broadcast(baseline)  # a row for each model
    return draws.join(base, ["dataset", "target"], "left").select(
        F.lit(method).alias("method"), "dataset", F.col("target").alias("target_attribute"), F.col("epsilon").alias("epsilon_m"), F.lit(penalty).alias("lambda"), F.col("cap").alias("L0"), "iteration",
        "leakage", F.col("baseline").alias("baseline_leakage_empty_mask"), "utility", F.col("num_chains").cast("long").alias("total_paths"), F.col("mask_size").cast("int").alias("mask_size"), F.col("n").alias("num_instantiated_cells"), "mask",
    )


def run_sweep(model: DataFrame, table: DataFrame, scratch: Scratch, *, epsilons=EPSILONS, caps=CAPS, iterations: int = ITERATIONS, penalty: float = 1000.0, seed: int = 7, orderings: tuple[str, ...] = ("greedy",)) -> DataFrame:
    """Run records of the exponential mechanism over all masks (exp) and over prefixes (gum; ablations as gum_random, gum_zero), and of the smallest masks (min)."""
    at = points(model.sparkSession, epsilons, caps)
    baseline = table.filter("mask = 0").select("dataset", "target", F.col("leakage_greedy").alias("baseline"))
    out = _records(draw(probabilities(all_mask_candidates(table, model), at, penalty=penalty), iterations, seed), "exp", baseline, penalty)
    for ordering in orderings:
        found = prefix_candidates(model, scratch, table, ordering, seed=seed)
        name = "gum" if ordering == "greedy" else f"gum_{ordering}"
        out = out.unionByName(_records(draw(probabilities(found, at, penalty=penalty), iterations, seed + 1), name, baseline, penalty))
    least = minimal_masks(model).join(table.select("dataset", "target", "mask", F.col("leakage_greedy").alias("leakage"), "num_chains"), ["dataset", "target", "mask"])
    least = least.select(
        "dataset", "target", F.lit(None).cast("double").alias("epsilon"), F.lit(None).cast("double").alias("cap"), F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iteration"),
        "leakage", (-F.col("mask_size")).cast("double").alias("utility"), "num_chains", "mask_size", "n", "mask",
    )
    return out.unionByName(_records(least, "min", baseline, penalty))
