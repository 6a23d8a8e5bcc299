"""Intermediate tables in the folder that every executor shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only where that setting is empty."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = getattr(shared_dir, "_local", None)
    if local is None:
        local = shared_dir._local = tempfile.mkdtemp(prefix="veilgraph-")
    return f"file://{local}"


def file_system(spark: SparkSession, path: str):
    """(path, its file system), both of the JVM."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def dealt(rows: DataFrame) -> DataFrame:
    """The rows over all cores: a table of few or small files is read by fewer tasks than there are cores."""
    parts = 2 * rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= parts else rows.repartition(parts)


class Scratch:
    """Parquet tables that cut lineage. ``drop`` removes one early; the rest go when Python ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/veilgraph-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass

    def _delete(self, path: str) -> None:
        where, system = file_system(self.spark, path)
        system.delete(where, True)
