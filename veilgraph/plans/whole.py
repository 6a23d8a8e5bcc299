"""The whole experiment in one call: load, sweep, ablate, extract, summarise and lay out the chart tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilgraph.operators import hypergraph, leakage, report
from veilgraph.operators.mechanisms import ORDERINGS
from veilgraph.operators.sweep import CAPS, EPSILONS, ITERATIONS, run_sweep
from veilgraph.operators.templates import TemplateStore, overheads
from veilgraph.sources import constraints, datasets, runs
from veilgraph.store import Scratch


def run_all(spark: SparkSession, files: dict[str, str], out: str, *, names: tuple[str, ...] = constraints.DATASETS, epsilons=EPSILONS, caps=CAPS, iterations: int = ITERATIONS, seed: int = 7) -> dict[str, DataFrame]:
    """Everything below ``out``: tables (from ``files``, dataset to CSV path), templates, runs, main, masks, statistics and charts. Returns what was written, by name."""
    out, scratch = out.rstrip("/"), Scratch(spark)
    written: dict[str, DataFrame] = {f"tables/{n}": spark.read.parquet(p) for n, p in datasets.populate(spark, files, f"{out}/tables").items()}
    catalog = constraints.catalog(spark, names)
    model = scratch.put(hypergraph.models(catalog), "model")
    table = TemplateStore(spark, f"{out}/templates").table(model)

    def put(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        written[name] = spark.read.parquet(f"{out}/{name}")
        return written[name]

    records = run_sweep(model, table, scratch, epsilons=epsilons, caps=caps, iterations=iterations, seed=seed, orderings=ORDERINGS)
    held = overheads(model, table).withColumnRenamed("target", "target_attribute")
    records = put("runs", runs.standard_runs(records.join(held, ["dataset", "target_attribute", "method"], "left")))
    runs.extract_main(records, f"{out}/main")
    written["main"] = spark.read.parquet(f"{out}/main")
    masks = put("masks", leakage.all_masks(table, model))
    statistics = report.main_metrics(written["main"], density=hypergraph.density(catalog))
    runs.write_statistics(statistics, f"{out}/statistics")
    written["statistics"] = statistics
    for name, chart in report.figures(records, masks).items():
        put(f"charts/{name}", chart)
    scratch.close()
    return written
