"""The newest insertion time of each (key, attribute), kept by a stream of insertions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def keep_newest_times(insertions: DataFrame, key: str, attribute: str, time: str, target_path: str, checkpoint: str, *, late: str = "2 days", pane: str = "1 day") -> StreamingQuery:
    """Appends to ``target_path`` the newest time of every key and attribute that a micro-batch has moved forward.

    State is the newest time by ``pane``; a pane goes once the watermark, ``late`` behind the newest time seen, has passed it, so state is bounded by the
    cells that were filled within that time and not by all cells. Insertions that come later than that are passed over. Rows without a key,
    attribute or time are left out.
    """
    cells = insertions.select(F.col(key).alias("key"), F.col(attribute).alias("attribute"), F.col(time).cast("timestamp").alias("time")).dropna()
    newest = cells.withWatermark("time", late).groupBy(F.window("time", pane), "key", "attribute").agg(F.max("time").alias("time"))
    return (
        newest.select("key", "attribute", "time")
        .writeStream.outputMode("update")
        .foreachBatch(lambda part, _: part.write.mode("append").parquet(target_path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def newest_times(spark: SparkSession, path: str) -> DataFrame:
    """(key, attribute, time) from what the stream has written: one aggregation, combined before its shuffle."""
    return spark.read.parquet(path).groupBy("key", "attribute").agg(F.max("time").alias("time"))


def times_by_key(newest: DataFrame, attributes: list[str]) -> DataFrame:
    """(insertionKey, a column for each attribute): seconds on the session's clock, as ``with_insertion_times`` reads them; null where a cell was never filled."""
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(time AS TIMESTAMP_NTZ))")
    return newest.groupBy(F.col("key").alias("insertionKey")).pivot("attribute", attributes).agg(F.max(seconds))
