"""Weights of denial constraints from sampled pairs, with confidence bounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.functions.expressions import Z_VALUES, wilson
from veilgraph.operators.pairs import Predicate, predicate_columns

#: Least premises by dataset, least valid pairs, and the thresholds of the sweep.
LEAST_PREMISES = {"adult": 200, "airport": 200, "flight": 74000, "hospital": 50, "tax": 10000}
LEAST_VALID = 200
GAMMAS = (0.25, 0.50)
GAMMA_SWEEP = (0.05, 0.10, 0.15, 0.25, 0.50)


def direction_counts(pairs: DataFrame, constraints: list[list[Predicate]], first_id: int = 1) -> DataFrame:
    """(dc_id, m, head_j, nV, k0, nE, k1) of all constraints in one pass over the pairs.

    Of the valid pairs (nV), k0 miss the head; of those where all other predicates hold (nE), k1 miss it.
    """
    sums, rows = [], []
    for at, dc in enumerate(constraints):
        ok, hold = predicate_columns(dc)
        sums.append(F.count_if(ok).alias(f"v{at}"))
        for j, head in enumerate(hold):
            premise = reduce(Column.__and__, [h for i, h in enumerate(hold) if i != j], ok)
            sums += [F.count_if(ok & ~head).alias(f"k{at}_{j}"), F.count_if(premise).alias(f"e{at}_{j}"), F.count_if(premise & ~head).alias(f"m{at}_{j}")]
            rows.append(F.struct(F.lit(first_id + at).alias("dc_id"), F.lit(len(dc)).alias("m"), F.lit(j).alias("head_j"), F.col(f"v{at}").alias("nV"), F.col(f"k{at}_{j}").alias("k0"), F.col(f"e{at}_{j}").alias("nE"), F.col(f"m{at}_{j}").alias("k1")))
    if not constraints:
        raise ValueError("there are no constraints")
    return pairs.agg(*sums).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def direction_stats(counts: DataFrame, *, z: float = Z_VALUES[0.90], least_valid: int = LEAST_VALID) -> DataFrame:
    """Adds UCB0, LCB1 and base = (LCB1 - UCB0) / (1 - UCB0). Base is 0, and nE counts as 0, where too few pairs are valid, UCB0 is 1 or no premise holds."""
    _, ucb = wilson(F.col("k0"), F.col("nV"), z)
    lcb, _ = wilson(F.col("k1"), F.col("nE"), z)
    seen = counts.withColumns({"u": ucb, "l": lcb})
    enough = F.col("nV") >= least_valid
    tells = enough & (1 - F.col("u") > 1e-12) & (F.col("nE") > 0)
    return seen.select(
        "dc_id", "m", "head_j", "nV", "k0", "k1", F.when(tells, F.col("nE")).otherwise(0).alias("nE"), F.when(enough, F.col("u")).alias("UCB0"), F.when(tells, F.col("l")).alias("LCB1"),
        F.when(tells, (F.col("l") - F.col("u")) / F.when(tells, 1 - F.col("u"))).otherwise(0.0).alias("base"),
    )


def best_heads(stats: DataFrame, least_premises: int) -> DataFrame:
    """The head with the largest base of each constraint (ties: the first); not below 0, and none (-1) if no head has enough premises."""
    eligible = F.col("nE") >= least_premises
    order = Window.partitionBy("dc_id").orderBy(eligible.desc(), F.when(eligible, F.col("base")).desc_nulls_last(), "head_j")
    best = stats.withColumn("__r", F.row_number().over(order)).filter("__r = 1")
    return best.select(
        "dc_id", "m", "nV", F.when(eligible, F.col("head_j")).otherwise(-1).alias("best_head_j"), F.when(eligible, F.col("nE")).otherwise(0).alias("nE_best"), "UCB0", "LCB1",
        F.when(eligible, F.greatest(F.col("base"), F.lit(0.0))).otherwise(0.0).alias("best_base"),
    )


def with_gammas(best: DataFrame, gammas: tuple[float, ...] = GAMMAS) -> DataFrame:
    """A row for each constraint and threshold, with weight = max(0, best_base - gamma)."""
    rows = best.withColumn("gamma", F.explode(F.array(*[F.lit(float(g)) for g in gammas])))
    return rows.withColumn("weight", F.greatest(F.lit(0.0), F.col("best_base") - F.col("gamma")))


def gamma_sweep(best: DataFrame, gammas: tuple[float, ...] = GAMMA_SWEEP, by: tuple[str, ...] = ()) -> DataFrame:
    """How many constraints keep a positive weight at each threshold."""
    return with_gammas(best, gammas).groupBy(*by, "gamma").agg(F.count(F.lit(1)).alias("n_dcs"), F.count_if(F.col("weight") > 0).alias("n_kept"))


def kept_weights(weighted: DataFrame) -> DataFrame:
    """The rows with a positive weight."""
    return weighted.filter("weight > 0")
