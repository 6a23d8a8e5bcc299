"""Approximate nearest neighbours: several shifted Hilbert orderings, windows of neighbouring keys, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.store import Scratch

#: Rows of a block that a task compares at once are at most so many; wider windows visit more blocks.
MOST_BLOCK, LEAST_BLOCK = 8192, 256


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (a row each, every number below 2**bits).

    Walks the bits from the top: an axis whose bit is set mirrors the lower bits of the first axis, one whose bit isn't
    set swaps them with it; Gray decoding and interleaving finish the key.
    """
    axes = [points[:, i].astype(np.uint64) for i in range(points.shape[1])]
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit, below = one << np.uint64(level), (one << np.uint64(level)) - one
        for i in range(len(axes)):
            is_set = (axes[i] & bit) > 0
            swap = np.where(is_set, np.uint64(0), (axes[0] ^ axes[i]) & below)
            axes[0] = np.where(is_set, axes[0] ^ below, axes[0] ^ swap)
            axes[i] = axes[i] ^ swap if i else axes[0]
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flip = np.zeros(len(points), np.uint64)
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        flip ^= np.where((axes[-1] & bit) > 0, bit - one, np.uint64(0))
    key = np.zeros(len(points), np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << one) | (((axis ^ flip) >> np.uint64(level)) & one)
    return key


class Curves:
    """Random projections, each shifted at random, of vectors scaled into the unit ball.

    For the largest inner product a stored vector gets one more coordinate that lifts it onto the sphere, and a query a zero
    there; the nearest on the sphere are then those of the largest product. Centres and scales come from a sample.
    """

    def __init__(self, sample: np.ndarray, largest: float, orderings: int, dims: int, bits: int, seed: int):
        rng = np.random.Generator(np.random.Philox(seed))
        self.largest, self.bits, self.orderings, self.dims = largest, bits, orderings, dims
        self.axes = rng.standard_normal((sample.shape[1] + 1, orderings * dims))
        self.shift = rng.random(orderings * dims)
        y = self._lifted(sample, False) @ self.axes
        self.centre = y.mean(0)
        self.spread = np.maximum(y.std(0), 1e-9) * 8

    def _lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        if query:
            return np.column_stack((x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))))
        scaled = x / self.largest
        return np.column_stack((scaled, np.sqrt(np.maximum(0.0, 1.0 - (scaled**2).sum(1)))))

    def keys(self, x: np.ndarray, query: bool) -> np.ndarray:
        """A key in each ordering (columns) for each vector."""
        y = (self._lifted(x, query) @ self.axes - self.centre) / self.spread + 0.5
        cells = np.clip((y + self.shift) / 2 * (1 << self.bits), 0, (1 << self.bits) - 1).astype(np.uint64)
        return np.column_stack([hilbert_keys(cells[:, s * self.dims : (s + 1) * self.dims], self.bits) for s in range(self.orderings)]).astype(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed component by component: the same digits whatever block a pair is met in."""
    total = np.zeros(len(x))
    for i in range(x.shape[1]):
        total += x[:, i] * y[:, i]
    return total


def _best(queries: np.ndarray, vectors: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, product) of each query's k largest products, ties to the smaller ``least``.

    A matrix product finds what may be among them: its last digits depend on the block, so whatever comes near the k-th is
    worked out anew before the cut.
    """
    rough = queries @ vectors.T
    slack = 1e-12 * (1.0 + np.linalg.norm(queries, axis=1) * np.sqrt((vectors * vectors).sum(1).max(initial=0.0))) * vectors.shape[1]
    cut = np.partition(rough, rough.shape[1] - k, 1)[:, rough.shape[1] - k] if rough.shape[1] > k else np.full(len(rough), -np.inf)
    q, v = np.nonzero(rough >= (cut - slack)[:, None])
    score = np.empty(len(q))
    for at in range(0, len(q), 1 << 16):  # very many ties are worked off in parts
        some = slice(at, at + (1 << 16))
        score[some] = exact_products(queries[q[some]], vectors[v[some]])
    order = np.lexsort((least[v], -score, q))
    q, v, score = q[order], v[order], score[order]
    first = np.searchsorted(q, np.arange(len(queries)))
    keep = np.arange(len(q)) - first[q] < k
    return q[keep], v[keep], score[keep]


def _exact_nearest(classes: DataFrame, queries: list, k: int) -> DataFrame:
    """(q, cid): the k largest products over all other classes for a bounded list of queries, brute force."""
    shared = classes.sparkSession.sparkContext.broadcast((np.array([r.cid for r in queries]), np.array([r.vector for r in queries], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, x = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            cid = batch.column(0).to_numpy()
            q, v, score = _best(x, _matrix(batch.column(2)), batch.column(1).to_numpy(), k + 1)
            other = own[q] != cid[v]
            yield pa.RecordBatch.from_arrays([pa.array(own[q][other]), pa.array(cid[v][other]), pa.array(score[other])], names=["q", "cid", "score"])

    found = classes.select("cid", "least", "vector").mapInArrow(run, "q long, cid long, score double")
    first = Window.partitionBy("q").orderBy(F.desc("score"), "cid")
    return found.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k).select("q", "cid")


def _placed(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds each row's rank in its ordering: Spark sorts by ranges, and ranges' sizes (a few numbers each) place them."""
    dealt = rows.repartitionByRange("o", "key", "side", "cid").sortWithinPartitions("o", "key", "side", "cid")
    dealt = dealt.select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i"))
    dealt = scratch.put(dealt, "sorted")
    sizes = dealt.groupBy("o", "p").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("low"))
    before = Window.partitionBy("o").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("o", "p", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("base"))
    return dealt.join(F.broadcast(sizes), ["o", "p"]).select("o", "side", "cid", (F.col("i") + F.col("base")).alias("rank"))  # a row for each range


def nearest(
    vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, orderings: int = 16, dims: int = 6, bits: int = 10, target: float = 0.97, sample: int = 2048, probes: int = 64, seed: int = 11
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k nearest others by inner product, ties to the smaller id.

    A query's own row takes no part in its answer; any other row may, with whatever id, the query's included. Equal vectors
    form one class, of which the k + 1 smallest ids (as often as they come) go on, so copies cost nothing. Each class has a place in
    each of ``orderings`` Hilbert orderings. The window is fitted on at most ``probes`` query vectors, whose exact nearest
    are found by brute force: it is so wide that a ``target`` share of them lies within it in some ordering. Every
    query then meets the blocks of neighbouring keys that its window touches, in every ordering, and exact double
    products, summed in component order, rank what it met. Projections are centred on a sample of ``sample`` vectors; every vector is indexed.

    Vectors that are null, zero, or hold null or non-finite components take no part; neither do rows with a null id.
    Vectors of different lengths have no product: each length is searched apart, a length after another. Repeated rows are rows: each asks, and may be found, as often as it comes.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), is_query.alias("query")).filter(F.col("id").isNotNull() & usable(F.col("vector")))
    digest = F.unhex(F.md5(F.array_join(F.transform("vector", lambda x: x.cast("double").cast("string")), ",").cast("binary")))
    named = scratch.put(rows.withColumn("e", digest), "named")
    lengths = named.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).collect()  # a row for each length
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in lengths:
        same = named if len(lengths) == 1 else named.filter(F.size("vector") == r.d)
        out = out.unionByName(_nearest(same, Scratch(spark), k, orderings, dims, bits, target, sample, probes, seed))
    return out


def _nearest(named: DataFrame, scratch: Scratch, k: int, orderings: int, dims: int, bits: int, target: float, sample: int, probes: int, seed: int) -> DataFrame:
    """The search among vectors of one length; ``named``: id, vector, query, e (the vector's digest)."""
    spark = named.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    first = Window.partitionBy("e").orderBy("id", "n")
    # copies of one row are numbered before the shuffle by class, so a very common vector brings k + 1 ids a partition at most
    ids = named.select("e", "id", F.monotonically_increasing_id().alias("n")).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).groupBy("e").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    whole = named.groupBy("e").agg(F.min("id").alias("least"), F.any_value("vector").alias("vector"), F.max("query").alias("asks"))
    classes = scratch.put(whole.join(ids, "e").withColumn("cid", F.monotonically_increasing_id()), "classes")
    largest = classes.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))).first()[0]
    some = classes.orderBy(F.xxhash64("e"), "e").limit(sample).select("vector").collect()
    curves = Curves(np.array([r.vector for r in some], np.float64), largest, orderings, dims, bits, seed)
    shared = spark.sparkContext.broadcast(curves)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, asks = _matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            for side, take in ((0, np.arange(len(x))), (1, np.flatnonzero(asks))):
                keys = shared.value.keys(x[take], bool(side)) if len(take) else np.empty((0, orderings), np.int64)
                cid = batch.column(0).to_numpy()[take]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(orderings, dtype=np.int32), len(take))), pa.array(keys.ravel()), pa.array(np.full(keys.size, side, np.int32)), pa.array(np.repeat(cid, orderings))], names=["o", "key", "side", "cid"]
                )

    places = scratch.put(_placed(classes.select("cid", "vector", "asks").mapInArrow(keyed, "o int, key long, side int, cid long"), scratch), "places")
    scratch.drop("sorted")
    probing = classes.filter("asks").orderBy(F.xxhash64("e", F.lit(1)), "e").limit(probes).select("cid", "vector").collect()
    if not probing:
        return empty
    pairs = F.broadcast(_exact_nearest(classes, probing, k))  # probes * k rows
    at = places.filter("side = 1").select("o", F.col("cid").alias("q"), F.col("rank").alias("from"))
    gaps = places.filter("side = 0").select("o", "cid", "rank").join(pairs, "cid").join(at, ["o", "q"]).groupBy("q", "cid").agg(F.min(F.abs(F.col("rank") - F.col("from"))).alias("gap"))
    window = int(gaps.agg(F.percentile("gap", F.lit(target))).first()[0] or 0) + 1
    block = min(max(window, LEAST_BLOCK), MOST_BLOCK)

    held = classes.select("cid", "least", "vector")
    stored = places.filter("side = 0").select("cid", "o", F.expr(f"rank div {block}").alias("b"), F.lit(0).alias("side"))
    asked = places.filter("side = 1").select("cid", "o", F.explode(F.sequence(F.greatest(F.expr(f"(rank - {window}) div {block}"), F.lit(0).cast("long")), F.expr(f"(rank + {window}) div {block}"))).alias("b"), F.lit(1).alias("side"))
    met = stored.union(asked).join(held, "cid").select("o", "b", "side", "cid", "least", "vector").repartition("o", "b").sortWithinPartitions("o", "b", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, least, x = None, [], [], []
        for batch in batches:
            o, b, side, cid, low = (batch.column(i).to_numpy() for i in range(5))
            vectors_ = _matrix(batch.column(5))
            new = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (b[1:] != b[:-1]) | (side[1:] != side[:-1])))
            for start, end in zip(new, [*new[1:], len(o)], strict=True):
                if now != (o[start], b[start]):
                    now, ids, least, x = (o[start], b[start]), [], [], []
                if not side[start]:
                    ids.append(cid[start:end])
                    least.append(low[start:end])
                    x.append(vectors_[start:end])
                elif ids:
                    ids, least, x = [np.concatenate(ids)], [np.concatenate(least)], [np.concatenate(x)]
                    for at_ in range(start, end, 512):
                        own = cid[at_ : min(end, at_ + 512)]
                        q, v, score = _best(vectors_[at_ : at_ + len(own)], x[0], least[0], k + 1)
                        yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(ids[0][v]), pa.array(least[0][v]), pa.array(score)], names=["q", "cid", "least", "score"])

    merged = met.mapInArrow(compare, "q long, cid long, least long, score double").groupBy("q", "cid").agg(F.first("least").alias("least"), F.first("score").alias("score"))
    top = Window.partitionBy("q").orderBy(F.desc("score"), "least", "cid")
    merged = merged.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= k + 1)
    each = merged.join(classes.select("cid", "ids"), "cid").select("q", "score", "cid", F.posexplode("ids").alias("copy", "vec_id"))
    nearest_first = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "cid", "copy")
    each = scratch.put(each.withColumn("r", F.row_number().over(nearest_first)).filter(F.col("r") <= k + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score", "cid"))).alias("found")), "found")
    asking = named.filter("query").select(F.col("id").alias("query_id"), "e").join(classes.select("e", F.col("cid").alias("q")), "e")
    # of the class's rows with the query's id one, whichever, is the query's own
    rows_ = asking.join(each, "q").withColumn("own", F.get(F.filter("found", lambda f: (f["vec_id"] == F.col("query_id")) & (f["cid"] == F.col("q"))), 0)["r"])
    others = rows_.select("query_id", F.slice(F.filter("found", lambda f: ~f["r"].eqNullSafe(F.col("own"))), 1, k).alias("found"))
    return others.select("query_id", F.posexplode("found").alias("at", "f")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "f.vec_id", "f.score")
