"""How much a deleted cell's value still leaks when further cells are deleted: chains of inference and four estimators.

For all masks of all models at once. A chain starts from what is observed, infers one cell with each edge and ends with the
target. Knowledge states of a mask are told apart by the inferred cells; of several paths to a state, all of one length,
the first by edge numbers stays. Masks are rows that Spark deals over tasks; the models, bounded by the catalogs, are sent
to each, and a task searches a block of masks at once (``chain_search``), so nothing but the masks is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgraph.operators.chain_search import Model, estimate, find_chains
from veilgraph.operators.hypergraph import MOST_ZONE
from veilgraph.store import Scratch

METHODS = ("greedy_disjoint", "noisy_or", "max_leakage", "nor_with_ie")
KEY = ["dataset", "target", "mask"]
#: So many models may be sent to every task; a model is a few kilobytes. Masks are searched in blocks of so many.
MOST_MODELS, BLOCK = 4096, 256


class LeakageError(ValueError):
    """An unknown estimator, a zone too large for all masks, or a probability outside [0, 1]."""


def _parts(df: DataFrame) -> int:
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def powerset(model: DataFrame) -> DataFrame:
    """Every mask of every model's zone (2 to the zone's size); zones above 20 attributes are refused."""
    large = model.filter(F.col("n") > MOST_ZONE).select("dataset", "n").first()
    if large is not None:
        raise LeakageError(f"the zone of {large.dataset} has {large.n} attributes; use the greedy prefixes instead of all masks")
    rows = model.withColumn("mask", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tbit") - 1)))
    return rows.withColumn("mask_size", F.bit_count("mask"))


def direct_leakage(masks: DataFrame) -> DataFrame:
    """Adds direct_chains, leakage_direct (over edges that infer the target from what is observed) and leakage_max, row by row."""
    hit = F.filter("edges", lambda e: (e["mask"].bitwiseAND(F.col("tbit")) != 0) & (e["mask"].bitwiseAND(F.col("mask")) == 0))
    with_hits = masks.withColumn("__direct", hit)
    return with_hits.withColumns(
        {
            "direct_chains": F.size("__direct"),
            "leakage_direct": 1 - F.aggregate("__direct", F.lit(1.0), lambda p, e: p * (1 - e["w"])),
            "leakage_max": F.aggregate("__direct", F.lit(0.0), lambda m, e: F.greatest(m, e["w"])),
        }
    ).drop("__direct")


def shared_models(model: DataFrame):
    """The models by (dataset, target), as a broadcast. Their number and their weights are checked: a weight is a probability."""
    rows = model.select("dataset", "target", "tbit", "edges").limit(MOST_MODELS + 1).collect()
    if len(rows) > MOST_MODELS:
        raise LeakageError(f"more than {MOST_MODELS} models can't be sent to every task")
    out = {}
    for r in rows:
        weights = np.array([e.w for e in r.edges], np.float64)
        if not ((weights >= 0) & (weights <= 1)).all():
            raise LeakageError(f"{r.dataset} has an edge whose weight isn't within [0, 1]")
        out[r.dataset, r.target] = Model(r.tbit, np.array([e["mask"] for e in r.edges], np.int64), weights)
    return model.sparkSession.sparkContext.broadcast(out)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, str], np.ndarray]]:
    """((dataset, target), rows of the batch) in blocks."""
    names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    places: dict[tuple[str, str], list[int]] = {}
    for i, name in enumerate(names):
        places.setdefault(name, []).append(i)
    for name, rows in places.items():
        for at in range(0, len(rows), BLOCK):
            yield name, np.array(rows[at : at + BLOCK])


def chains(masks: DataFrame, model: DataFrame, *, with_edges: bool = False) -> DataFrame:
    """(dataset, target, mask, level, path, eid, w, inferred): every chain; path orders the states of a level.

    ``masks``: (dataset, target, mask). ``with_edges`` adds edges, the numbers of the chain's edges.
    """
    shared = shared_models(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, rows in _blocks(batch):
                own = batch.take(pa.array(rows))
                c = find_chains(shared.value[name], own.column(2).to_numpy(), with_edges=with_edges)
                columns = [x.take(pa.array(c.mask)) for x in own.columns[:3]]
                columns += [pa.array(c.level.astype(np.int32)), pa.array(c.path), pa.array(c.eid.astype(np.int32)), pa.array(c.weight), pa.array(c.inferred)]
                if with_edges:
                    columns.append(pa.array([np.flatnonzero(e).astype(np.int32) for e in c.edges], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=fields)

    schema = "dataset string, target string, mask long, level int, path long, eid int, w double, inferred long" + (", edges array<int>" if with_edges else "")
    fields = [f.split(" ")[0] for f in schema.split(", ")]
    return masks.select(*KEY).repartition(_parts(masks), *KEY).mapInArrow(run, schema)


def leakage_table(model: DataFrame, scratch: Scratch, masks: DataFrame | None = None, *, method: str = "greedy_disjoint") -> DataFrame:
    """The estimators for the given masks, or for every mask; leakage_ie only if ``method`` is nor_with_ie. A mask without chains leaks 0.

    ``masks``: (dataset, target, mask). The result doesn't depend on budgets, caps or penalties, so one table serves any sweep.
    """
    method_column(method)
    wanted = (powerset(model) if masks is None else masks).select(*KEY).distinct()
    shared, bound = shared_models(model), method == "nor_with_ie"
    values = ["num_chains", "active_chains", "blocked_chains", "leakage_max", "leakage_greedy", "leakage_noisy_or"] + ["leakage_ie"] * bound

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, rows in _blocks(batch):
                own = batch.take(pa.array(rows))
                found = estimate(shared.value[name], own.column(2).to_numpy(), bound=bound)
                yield pa.RecordBatch.from_arrays([*own.columns[:3], *[pa.array(found[v]) for v in values]], names=KEY + values)

    schema = T.StructType([T.StructField("dataset", T.StringType()), T.StructField("target", T.StringType()), T.StructField("mask", T.LongType())])
    for v in values:
        schema.add(v, T.LongType() if v.endswith("chains") else T.DoubleType())
    known = wanted.join(F.broadcast(model.select("dataset", "target")), ["dataset", "target"], "left_semi")
    # masks are few bytes but much work, so their number of parts is given and not left to be merged by size
    table = known.repartition(_parts(model), *KEY).mapInArrow(run, schema).withColumn("mask_size", F.bit_count("mask"))
    return scratch.put(table, "leakage")


def with_method(table: DataFrame, model: DataFrame, method: str) -> DataFrame:
    """The table, or where it lacks the estimator asked for, one of the same masks that has it."""
    if method == "nor_with_ie" and "leakage_ie" not in table.columns:
        return leakage_table(model, Scratch(model.sparkSession), table.select(*KEY), method=method)
    return table


def method_column(method: str) -> Column:
    """An estimator's column of the leakage table."""
    names = {"greedy_disjoint": "leakage_greedy", "noisy_or": "leakage_noisy_or", "max_leakage": "leakage_max", "nor_with_ie": "leakage_ie"}
    if method not in names:
        raise LeakageError(f"unknown estimator {method!r}; there are {', '.join(METHODS)}")
    return F.col(names[method])


def all_masks(table: DataFrame, model: DataFrame, cap: float = 0.2, penalty: float = 1000.0) -> DataFrame:
    """A row for each mask with its names, three estimators and utilities, and whether max <= greedy <= noisy-or."""
    from veilgraph.functions.expressions import bits_to_names, utility

    rows = table.join(F.broadcast(model.select("dataset", "target", "names", "n")), ["dataset", "target"])
    util = {f"utility_{k}": utility(F.col(f"leakage_{k}"), F.col("mask_size"), F.lit(cap), F.lit(penalty)) for k in ("noisy_or", "greedy", "max")}
    fine = (F.col("leakage_max") <= F.col("leakage_greedy") + 1e-9) & (F.col("leakage_greedy") <= F.col("leakage_noisy_or") + 1e-9)
    return rows.withColumns(util | {"bounds_ok": fine}).select(
        "dataset", "target", F.array_join(bits_to_names(F.col("mask"), F.col("names")), "|").alias("mask_names"), "mask", "mask_size", F.col("n").alias("inference_zone_size"),
        "leakage_noisy_or", "leakage_greedy", "leakage_max", *util, "bounds_ok",
    )
