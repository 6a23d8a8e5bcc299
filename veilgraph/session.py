"""A session with the settings that the engine is tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def session(name: str = "veilgraph", **more: str) -> SparkSession:
    """The active session, or a new one (on this machine's cores unless a master is configured)."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | more)
    if "spark.master" not in more and "SPARK_REMOTE" not in os.environ and "MASTER" not in os.environ:
        builder = builder.config("spark.master", f"local[{os.environ.get('BENCH_CPUS', '*')}]")
    return builder.getOrCreate()
