"""A stream of deletion requests, answered in micro-batches against a table that stays as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from veilgraph.operators.deletion import mask_to_null, requests_from_masks
from veilgraph.operators.mechanisms import draw_for


def answer_stream(requests: DataFrame, rows: DataFrame, chosen: DataFrame, model: DataFrame, key: str, target_path: str, checkpoint: str, *, seed: int | None = None) -> StreamingQuery:
    """Appends to ``target_path`` each requested row without the cells of its private mask.

    ``requests``: a stream of (key, dataset, target); ``chosen``: candidates with probabilities at one point, as the mechanisms give
    them. Each batch draws its masks anew (the seed moves on with the batch) and joins only the requested rows.
    """

    def batch(part: DataFrame, number: int) -> None:
        part = part.dropDuplicates([key, "dataset", "target"]).persist()
        if not part.isEmpty():
            masks = draw_for(part, chosen, key, None if seed is None else seed + number).select(key, "dataset", "target", "mask")
            named = requests_from_masks(masks, model, key)
            mask_to_null(rows.join(named.select(key), key, "left_semi"), named, key).write.mode("append").parquet(target_path)
        part.unpersist()

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
