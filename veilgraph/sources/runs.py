"""Run records: one row for each deletion request that was answered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.store import file_system

#: The run record's columns.
RUN = "method string, dataset string, target_attribute string, epsilon_m double, lambda double, L0 double, total_time double, init_time double, model_time double, del_time double, leakage double, baseline_leakage_empty_mask double, utility double, total_paths long, mask_size int, memory_overhead_bytes long, num_instantiated_cells int"
REQUIRED = ("method", "dataset", "L0", "leakage", "mask_size")


def read_runs(spark: SparkSession, path: str, *, private_only: bool = False) -> DataFrame:
    """All run files below a folder. Missing required columns are an error, other missing columns are null; ``private_only`` keeps rows with a positive budget."""
    df = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path)
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"run files lack {', '.join(missing)}")
    names = [f.strip().split(" ") for f in RUN.split(",")]
    out = df.select(*[(F.col(n).try_cast(k) if n in df.columns else F.lit(None).cast(k)).alias(n) for n, k in names])
    return out.filter("epsilon_m > 0") if private_only else out


def labelled(runs: DataFrame, method: str) -> DataFrame:
    """Runs under one method's name."""
    return runs.withColumn("method", F.lit(method))


def at_point(runs: DataFrame, epsilon: float, cap: float) -> DataFrame:
    """Runs whose budget and cap round (5 digits) to a point, with times in ms, memory in kB and leakage within [0, 1]."""
    near = lambda c, v: F.round(c, 5) == F.round(F.lit(v), 5)
    times = {c: F.col(c) * 1000 for c in ("total_time", "init_time", "model_time", "del_time")}
    chosen = runs.filter(near("epsilon_m", epsilon) & near("L0", cap))
    return chosen.withColumns(times | {"memory_kb": F.col("memory_overhead_bytes") / 1024, "leakage": F.greatest(F.lit(0.0), F.least(F.lit(1.0), "leakage"))})


def titled(masks: DataFrame) -> DataFrame:
    """All-mask rows with capitalised dataset names."""
    return masks.withColumn("dataset", F.initcap("dataset"))


def standard_runs(records: DataFrame) -> DataFrame:
    """The run record's columns in order: the total time is that of the phases (a missing phase takes none, three missing ones make no total); columns that are missing are null, others go."""
    phases = [F.col(c).cast("double") if c in records.columns else F.lit(None).cast("double") for c in ("init_time", "model_time", "del_time")]
    some = F.coalesce(*phases).isNotNull()
    total = sum((F.coalesce(p, F.lit(0.0)) for p in phases), F.lit(0.0))
    own = records.withColumn("total_time", F.when(some, total))
    names = [f.strip().split(" ") for f in RUN.split(",")]
    return own.select(*[(F.col(n).cast(k) if n in own.columns else F.lit(None).cast(k)).alias(n) for n, k in names])


def write_statistics(statistics: DataFrame, path: str) -> None:
    """One CSV file with a header; statistics are a row for each method and dataset."""
    statistics.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def table_exists(spark: SparkSession, name: str) -> bool:
    """Whether a table, or a Parquet folder, of this name is there."""
    if "/" not in name:
        return spark.catalog.tableExists(name)
    where, system = file_system(spark, name)
    return system.exists(where)


def append_runs(runs: DataFrame, path: str) -> None:
    """Adds run records to a Parquet table."""
    runs.write.mode("append").parquet(path)


def extract_main(runs: DataFrame, path: str, epsilon: float = 0.1, cap: float = 0.2) -> None:
    """The rows of the main point (all rows of methods without a budget), by method and dataset."""
    main = runs.filter(F.col("epsilon_m").isNull() | ((F.round("epsilon_m", 5) == epsilon) & (F.round("L0", 5) == cap)))
    main.write.mode("overwrite").partitionBy("method", "dataset").parquet(path)
