"""Leakage tables that are kept between sessions, with a log of what building them took, and what each method has to hold."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.operators.leakage import KEY, leakage_table, method_column
from veilgraph.operators.mechanisms import program_lines
from veilgraph.store import Scratch, file_system

LOG = "dataset string, target string, method string, fingerprint string, masks long, build_time double"
#: The parts of the kept table, and what makes a model's rows its own.
PARTS = ["method", "dataset", "target", "fingerprint"]


def fingerprint() -> Column:
    """A name for a model's attributes, edges and weights."""
    return F.md5(F.to_json(F.struct("names", "edges")).cast("binary"))


class TemplateStore:
    """One Parquet table below ``path`` for all models, in parts by estimator, dataset, target and model; a model that changes is built anew.

    Leakage depends on no budget, cap or penalty, so these aren't part of the key. What isn't there is built in one go, whatever the
    number of models, and a question for some models reads their parts alone, in one scan.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, model: DataFrame, method: str = "greedy_disjoint") -> DataFrame:
        """The leakage table of all masks of the models; what isn't there is built, written and logged."""
        method_column(method)
        asked = model.select("dataset", "target", fingerprint().alias("fingerprint"))
        there = self.build_times().filter(F.col("method") == method).select("dataset", "target", "fingerprint").distinct()
        scratch = Scratch(self.spark)
        missing = scratch.put(asked.join(there, ["dataset", "target", "fingerprint"], "left_anti"), "missing")
        if not missing.isEmpty():
            began = time.perf_counter()
            own = model.join(missing, ["dataset", "target"], "left_semi")
            built = leakage_table(own, scratch, method=method).join(F.broadcast(missing), ["dataset", "target"]).withColumn("method", F.lit(method))  # a row for each model
            # parts of a build that was broken off are written over
            built.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(f"{self.path}/tables")
            seconds = time.perf_counter() - began
            log = built.groupBy(*PARTS).agg(F.count(F.lit(1)).alias("masks")).withColumn("build_time", F.lit(seconds))
            log.select("dataset", "target", "method", "fingerprint", "masks", "build_time").coalesce(1).write.mode("append").parquet(f"{self.path}/build_times")
        values = ["num_chains long", "active_chains long", "blocked_chains long", "leakage_max double", "leakage_greedy double", "leakage_noisy_or double"] + ["leakage_ie double"] * (method == "nor_with_ie")
        kept = self.spark.read.schema(", ".join(["mask long", *values, "mask_size int", *[f"{p} string" for p in PARTS]])).parquet(f"{self.path}/tables")
        found = kept.filter(F.col("method") == method).join(F.broadcast(asked), ["dataset", "target", "fingerprint"], "left_semi")  # a row for each model
        return found.select(*KEY, *[v.split(" ")[0] for v in values], "mask_size")

    def build_times(self) -> DataFrame:
        """What was built, and how many seconds the job took that built it."""
        if not exists(self.spark, f"{self.path}/build_times"):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(f"{self.path}/build_times")

    def sizes(self, model: DataFrame, method: str = "greedy_disjoint") -> dict[tuple[str, str], int]:
        """Bytes of each model's part of the table; 0 for one that isn't there."""
        rows = model.select("dataset", "target", fingerprint().alias("fingerprint")).collect()  # a row for each model
        return {(r.dataset, r.target): size_of(self.spark, f"{self.path}/tables/method={method}/dataset={r.dataset}/target={r.target}/fingerprint={r.fingerprint}") for r in rows}


def exists(spark: SparkSession, path: str) -> bool:
    where, system = file_system(spark, path)
    return system.exists(where)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes below a path; 0 if there is none."""
    where, system = file_system(spark, path)
    return int(system.getContentSummary(where).getLength()) if system.exists(where) else 0


def model_sizes(model: DataFrame) -> DataFrame:
    """(dataset, target, bytes): a model's edges and names as JSON text."""
    return model.select("dataset", "target", F.octet_length(F.to_json(F.struct("names", "edges"))).cast("long").alias("bytes"))


def program_sizes(model: DataFrame) -> DataFrame:
    """(dataset, target, bytes): the integer program's text, a line break after each line."""
    return program_lines(model).groupBy("dataset", "target").agg(F.sum(F.octet_length("line") + 1).cast("long").alias("bytes"))


def write_program(model: DataFrame, path: str) -> None:
    """One text file for each (dataset, target) with the integer program's lines in order."""
    whole = program_lines(model).groupBy("dataset", "target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("value"))
    whole.write.mode("overwrite").partitionBy("dataset", "target").text(path)


def overheads(model: DataFrame, table: DataFrame) -> DataFrame:
    """(dataset, target, method, memory_overhead_bytes): what a method holds beside the rows: min its program's text, gum the
    model, exp the model's table of masks (two numbers of 8 bytes for each)."""
    held = table.groupBy("dataset", "target").agg((F.count(F.lit(1)) * 16).alias("bytes"))
    parts = {"min": program_sizes(model), "gum": model_sizes(model), "exp": held}
    out = None
    for method, rows in parts.items():
        own = rows.select("dataset", "target", F.lit(method).alias("method"), F.col("bytes").alias("memory_overhead_bytes"))
        out = own if out is None else out.unionByName(own)
    return out
