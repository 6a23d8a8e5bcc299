"""Deleting cells: requests name a key and the columns to set to null."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.store import Scratch

#: Requests up to so many rows are sent to every task; more are joined by key.
BROADCAST_ROWS = 100_000


def mask_to_null(rows: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Rows with the requested cells set to null; the input stays as it is.

    ``requests``: (key column, names array<string>). Names match columns whatever their case; unknown names do nothing, and several
    requests for one key add up. Every other row and column is unchanged. A null key matches no request.
    """
    merged = requests.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list(F.transform("names", lambda n: F.lower(n))))).alias("__names"))  # as many as a key has requests
    few = requests.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(merged) if few else merged, key, "left")
    gone = lambda c: F.coalesce(F.array_contains("__names", c.lower()), F.lit(False))
    return joined.select(*[F.col(f"`{c}`") if c == key else F.when(~gone(c), F.col(f"`{c}`")).alias(c) for c in rows.columns])


def requests_from_masks(masks: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """(key, names) from (key, dataset, target, mask): the mask's attributes and the target itself."""
    from veilgraph.functions.expressions import bits_to_names

    rows = masks.join(F.broadcast(model.select("dataset", "target", "names")), ["dataset", "target"])  # a row for each model
    return rows.select(key, F.concat(bits_to_names(F.col("mask"), F.col("names")), F.array("target")).alias("names"))


def random_key(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """One row, chosen by md5 of the seed and its key: the same on every run and cluster."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key).limit(1)


@contextmanager
def working_copy(rows: DataFrame, name: str) -> Iterator[DataFrame]:
    """A copy of a table in the shared folder, dropped at the end whatever happens."""
    scratch = Scratch(rows.sparkSession)
    try:
        yield scratch.put(rows, name)
    finally:
        scratch.close()


def with_insertion_times(requests: DataFrame, times: DataFrame | None, key: str) -> DataFrame:
    """Requests with ``times``, a map from attribute to insertion time; without a table, or a row in it, empty (which reads as 0)."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    if times is None:
        return requests.withColumn("times", none)
    names = [c for c in times.columns if c != "insertionKey"]
    pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*[F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(0)) for c in names]))
    own = times.select(F.col("insertionKey").alias(key), pairs.alias("times"))
    return requests.join(own, key, "left").withColumn("times", F.coalesce("times", none))
