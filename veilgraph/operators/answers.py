"""Answering one deletion request by each method, with a run record of what it chose and how long each phase took."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.functions.expressions import bits_to_names, utility
from veilgraph.operators.deletion import mask_to_null
from veilgraph.operators.leakage import leakage_table, method_column
from veilgraph.operators.mechanisms import exponential_mask, minimal_masks, prefix_mask
from veilgraph.operators.templates import overheads
from veilgraph.sources.runs import standard_runs
from veilgraph.store import Scratch

METHODS = ("min", "exp", "gum")


def choose(model: DataFrame, scratch: Scratch, method: str, *, epsilon: float = 0.1, cap: float = 0.2, penalty: float = 1000.0, ordering: str = "greedy", estimator: str = "greedy_disjoint", seed: int | None = None, table: DataFrame | None = None) -> DataFrame:
    """(dataset, target, mask, mask_size, leakage, utility, num_chains, n, names): one choice for each model. ``table`` is used if given, else what is needed is computed."""
    if method == "min":
        best = minimal_masks(model)
        found = table if table is not None else leakage_table(model, Scratch(model.sparkSession), best.select("dataset", "target", "mask"), method=estimator)
        found = found.select("dataset", "target", "mask", method_column(estimator).alias("leakage"), "num_chains")
        own = best.join(found, ["dataset", "target", "mask"])
        own = own.withColumn("utility", utility(F.col("leakage"), F.col("mask_size"), F.lit(cap), F.lit(penalty)))
    elif method == "exp":
        table = leakage_table(model, scratch, method=estimator) if table is None else table
        own = exponential_mask(model, table, epsilon, cap, penalty=penalty, method=estimator, seed=seed)
    elif method == "gum":
        own = prefix_mask(model, scratch, epsilon, cap, penalty=penalty, ordering=ordering, method=estimator, seed=seed)
    else:
        raise ValueError(f"unknown method {method!r}; there are {', '.join(METHODS)}")
    return own.select("dataset", "target", "mask", "mask_size", "leakage", "utility", "num_chains", "n", "names")


def run_request(rows: DataFrame, key: str, value, model: DataFrame, method: str, target_path: str, *, epsilon: float = 0.1, cap: float = 0.2, penalty: float = 1000.0, ordering: str = "greedy", estimator: str = "greedy_disjoint", seed: int | None = None, table: DataFrame | None = None) -> DataFrame:
    """Writes ``rows`` with the cells of one request set to null to ``target_path``; returns the run record.

    ``model`` holds one (dataset, target). Phases are measured apart: init reads the model, model chooses the mask and works
    out its leakage, del writes the rows. A smallest mask has no budget.
    """
    spark, clock = rows.sparkSession, [time.perf_counter()]

    def tick() -> float:
        clock.append(time.perf_counter())
        return clock[-1] - clock[-2]

    scratch = Scratch(spark)
    model = scratch.put(model, "model")
    times = {"init_time": tick()}
    chosen = scratch.put(choose(model, scratch, method, epsilon=epsilon, cap=cap, penalty=penalty, ordering=ordering, estimator=estimator, seed=seed, table=table), "chosen")
    empty = model.select("dataset", "target", F.lit(0).cast("long").alias("mask"))
    base = leakage_table(model, Scratch(spark), empty, method=estimator).select("dataset", "target", method_column(estimator).alias("baseline_leakage_empty_mask"))
    base = scratch.put(base, "base")
    times["model_time"] = tick()
    ask = chosen.select(F.lit(value).alias(key), F.concat("names", F.array("target")).alias("names"))
    mask_to_null(rows, ask, key).write.mode("overwrite").parquet(target_path)
    times["del_time"] = tick()
    bytes_ = overheads(model, table if table is not None else empty).filter(F.col("method") == method).drop("method")
    private = method != "min"
    record = chosen.join(base, ["dataset", "target"]).join(bytes_, ["dataset", "target"])
    return standard_runs(
        record.withColumns(
            {
                "method": F.lit(method), "target_attribute": F.col("target"), "epsilon_m": F.lit(epsilon if private else None).cast("double"), "lambda": F.lit(penalty), "L0": F.lit(cap if private else None).cast("double"),
                "total_paths": F.col("num_chains"), "num_instantiated_cells": F.col("n"), **{k: F.lit(v) for k, v in times.items()},
            }
        )
    )


def names_of(chosen: DataFrame, model: DataFrame) -> DataFrame:
    """Masks by name."""
    return chosen.join(F.broadcast(model.select("dataset", "target", F.col("names").alias("zone"))), ["dataset", "target"]).withColumn("names", bits_to_names(F.col("mask"), F.col("zone"))).drop("zone")
