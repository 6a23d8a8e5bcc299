"""Which further cells to delete: private choices over all masks or over greedy prefixes, and the exact smallest mask."""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.functions.expressions import bits_to_names, mechanism_score, softmax, uniform, utility
from veilgraph.operators.chain_search import smallest_masks, wider_masks
from veilgraph.operators.leakage import KEY, LeakageError, _parts, leakage_table, method_column, with_method
from veilgraph.store import Scratch

ORDERINGS = ("greedy", "random", "zero")
POINT = ["dataset", "target", "epsilon", "cap"]
#: Draws of a point that one task answers at most; masks of one size that a task follows alone.
DRAWS_EACH, FRONTIER = 1 << 16, 20_000


def points(spark, epsilons, caps) -> DataFrame:
    """(epsilon, cap): every combination of budgets and leakage caps."""
    return spark.createDataFrame([(float(e), float(c)) for e in epsilons for c in caps], "epsilon double, cap double")


def probabilities(candidates: DataFrame, at: DataFrame, *, penalty: float = 1000.0, normalize: bool = False) -> DataFrame:
    """Adds utility and p for every point: the exponential mechanism over each (dataset, target)'s candidates.

    ``candidates``: dataset, target, mask, mask_size, leakage, n. The sweep is one join with the points (a few dozen rows, broadcast)
    and one window; the leakage table is shared by all points.
    """
    rows = candidates.crossJoin(F.broadcast(at))
    scored = rows.withColumn("utility", utility(F.col("leakage"), F.col("mask_size"), F.col("cap"), F.lit(penalty), F.col("n") if normalize else None))
    return scored.withColumn("p", softmax(mechanism_score(F.col("epsilon"), F.col("utility"), F.col("n")), *POINT))


def all_mask_candidates(table: DataFrame, model: DataFrame, method: str = "greedy_disjoint") -> DataFrame:
    """Every mask with the leakage of one estimator."""
    return with_method(table, model, method).select(*KEY, "mask_size", method_column(method).alias("leakage"), "num_chains").join(F.broadcast(model.select("dataset", "target", "n")), ["dataset", "target"])


def prefix_masks(model: DataFrame, singles: DataFrame | None, ordering: str = "greedy", seed: int = 7) -> DataFrame:
    """(dataset, target, step, mask, mask_size): the n + 1 prefixes of an ordering of the zone.

    greedy: by how much deleting a cell alone lowers leakage, then name (``singles``: dataset, target, mask, leakage of the
    masks of at most one cell). random: by md5 of the seed and the name. zero: by name.
    """
    if ordering not in ORDERINGS:
        raise ValueError(f"unknown ordering {ordering!r}; there are {', '.join(ORDERINGS)}")
    cells = model.select("dataset", "target", F.posexplode("names").alias("pos", "name")).withColumn("bit", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos")))
    if ordering == "greedy":
        base = singles.filter("mask = 0").select("dataset", "target", F.col("leakage").alias("l0"))
        gains = singles.filter("mask != 0").join(base, ["dataset", "target"]).select("dataset", "target", F.col("mask").alias("bit"), (F.col("l0") - F.col("leakage")).alias("gain"))
        cells = cells.join(gains, ["dataset", "target", "bit"])
        keys: list[Column] = [F.desc("gain"), F.asc("name")]
    elif ordering == "random":
        keys = [uniform(F.lit(str(seed)), F.col("name")).asc(), F.asc("name")]
    else:
        keys = [F.asc("pos")]
    order = Window.partitionBy("dataset", "target").orderBy(*keys)
    steps = cells.select("dataset", "target", F.row_number().over(order).alias("step"), F.sum("bit").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("mask"))
    empty = model.select("dataset", "target", F.lit(0).alias("step"), F.lit(0).cast("long").alias("mask"))
    return empty.union(steps).withColumn("mask_size", F.col("step"))


def prefix_candidates(model: DataFrame, scratch: Scratch, table: DataFrame | None = None, ordering: str = "greedy", method: str = "greedy_disjoint", seed: int = 7) -> DataFrame:
    """The prefixes with their leakage. Without a leakage table only the masks that are needed are computed: 2n + 2 for each model."""

    def leak(masks: DataFrame, name: str) -> DataFrame:
        if table is not None:
            found = with_method(table.join(masks.select(*KEY), KEY, "left_semi"), model, method)
            return masks.join(found.select(*KEY, method_column(method).alias("leakage"), "num_chains"), KEY)
        found = leakage_table(model, Scratch(model.sparkSession), masks, method=method)
        return scratch.put(masks.join(found.select(*KEY, method_column(method).alias("leakage"), "num_chains"), KEY), name)

    singles = None
    if ordering == "greedy":
        one = model.select("dataset", "target", F.explode(F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))).alias("mask"))
        singles = leak(one, "singles")
    steps = leak(prefix_masks(model, singles, ordering, seed), f"prefixes_{ordering}")
    return steps.join(F.broadcast(model.select("dataset", "target", "n")), ["dataset", "target"])


def expected(chosen: DataFrame) -> DataFrame:
    """(..., e_mask, e_leakage): what the mechanism gives on average at each point."""
    return chosen.groupBy(*POINT).agg(F.sum(F.col("p") * F.col("mask_size")).alias("e_mask"), F.sum(F.col("p") * F.col("leakage")).alias("e_leakage"))


_CHOICE = ["mask", "mask_size", "leakage", "utility", "p", "num_chains", "n"]


def _looked_up(asked: DataFrame, chosen: DataFrame, payload: str, parts: int) -> DataFrame:
    """(..., payload, mask, mask_size, leakage, utility, p, num_chains, n): the mask at each asked place of its point's distribution function.

    ``asked``: point columns, part, u, payload. The function's steps, in the order of size and number, and the asked places are sorted
    together; a place takes the first step that isn't below it. Steps are repeated for every part, so a point's draws are dealt out.
    """
    order = Window.partitionBy(*POINT).orderBy("mask_size", "mask")
    step = F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = F.lead("mask").over(order).isNull()  # rounding can't leave a draw without a mask
    steps = chosen.select(*POINT, F.struct(*_CHOICE).alias("choice"), F.when(last, 2.0).otherwise(step).alias("at"))
    steps = steps.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))) if parts > 1 else F.lit(0))
    both = steps.unionByName(asked.select(*POINT, F.col("part").cast("int").alias("part"), F.col("u").alias("at"), payload), allowMissingColumns=True)
    downward = Window.partitionBy(*POINT, "part").orderBy(F.desc("at"), F.col("choice").isNull(), F.desc("choice.mask_size"), F.desc("choice.mask")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.select(*POINT, payload, F.col("choice").isNull().alias("asked"), F.last("choice", ignorenulls=True).over(downward).alias("choice"))
    return found.filter("asked").select(*POINT, payload, "choice.*")


def _seed(seed: int | None) -> Column:
    return F.lit(str(secrets.randbits(62) if seed is None else seed))


def draw(chosen: DataFrame, times: int, seed: int | None = None) -> DataFrame:
    """(..., iteration, mask, ...): ``times`` independent draws at each point, by inverse distribution functions.

    The uniforms are md5 of (seed, point, iteration), which any engine repeats; without a seed a random one is taken. A task sorts at most
    DRAWS_EACH draws of a point with its masks.
    """
    text = [F.col("dataset"), F.col("target"), F.col("epsilon").cast("string"), F.col("cap").cast("string")]
    each = chosen.sparkSession.range(times).select(F.col("id").cast("int").alias("iteration"))
    asked = chosen.select(*POINT).distinct().crossJoin(each)  # the rows of the result
    asked = asked.select("*", F.floor(F.col("iteration") / DRAWS_EACH).alias("part"), uniform(_seed(seed), *text, F.col("iteration").cast("string")).alias("u"))
    return _looked_up(asked, chosen, "iteration", -(-times // DRAWS_EACH))


def draw_for(requests: DataFrame, chosen: DataFrame, key: str, seed: int | None = None) -> DataFrame:
    """(..., key, mask, ...): an own draw for each request (key, dataset, target); ``chosen`` holds one point for each model.

    The uniforms are md5 of (seed, dataset, target, key). Requests meet their model's distribution in groups dealt by the
    key's hash, of about DRAWS_EACH rows, whatever the share of one model.
    """
    deal = max(1, -(-requests.count() // DRAWS_EACH))
    u = uniform(_seed(seed), F.col("dataset"), F.col("target"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    points_ = chosen.select(*POINT).distinct()
    rows = requests.select(key, "dataset", "target", u.alias("u"), F.pmod(F.xxhash64(key), F.lit(deal)).alias("part"))
    return _looked_up(rows.join(F.broadcast(points_), ["dataset", "target"]), chosen, key, deal)  # a row for each model


def gumbel_draw(chosen: DataFrame, times: int = 1, seed: int | None = None) -> DataFrame:
    """(..., iteration, mask, ...): the same law as ``draw``, without sorting or gathering a point's masks.

    Every mask adds Gumbel noise to its score, and the largest sum is drawn: one aggregation, combined before its shuffle. It costs a
    hash for each mask and draw, so it suits few draws over many masks. The uniforms are md5 of (seed, point, mask, iteration).
    """
    text = [F.col("dataset"), F.col("target"), F.col("epsilon").cast("string"), F.col("cap").cast("string"), F.col("mask").cast("string"), F.col("iteration").cast("string")]
    rows = chosen.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    noisy = mechanism_score(F.col("epsilon"), F.col("utility"), F.col("n")) - F.log(-F.log(uniform(_seed(seed), *text)))
    best = rows.groupBy(*POINT, "iteration").agg(F.max_by(F.struct(*_CHOICE), F.struct(noisy, "mask")).alias("choice"))
    return best.select(*POINT, "iteration", "choice.*")


def minimal_masks(model: DataFrame) -> DataFrame:
    """(all columns of the model but tbit and edges, mask, mask_size, n_optima; names: the mask's): a smallest mask from which closure can't reach the target.

    A row for each row of ``model``, so per-key models of ``time_filtered`` keep their keys; the least mask by number stands for the
    optima. It solves the same problem as the integer program that ``program_lines`` writes. A zone without edges needs no mask.

    Each different problem is solved once. Masks grow by size: one that isn't safe is followed by itself with each of the visible
    cells that infer the target together, one of which every safe mask must hold. A task follows a problem while a size has no more than
    ``FRONTIER`` masks; from then on they are rows, a table for each size, in which equal masks meet by a shuffle.
    """
    large = model.filter(F.col("n") > 62).select("dataset", "n").first()
    if large is not None:
        raise LeakageError(f"the zone of {large.dataset} has {large.n} attributes; at most 62 can be searched")
    spark = model.sparkSession
    scratch = Scratch(spark)
    lead = [c for c in model.columns if c not in ("tbit", "edges")]
    rows = model.select(*lead, "tbit", F.array_sort(F.array_distinct(F.transform("edges", lambda e: e["mask"]))).alias("unique"))
    problems = scratch.put(rows.select("tbit", "unique").distinct().withColumn("pid", F.monotonically_increasing_id()), "problems")
    names = ["pid", "safe", "mask", "size"]
    schema = "pid long, safe boolean, mask long, size int"

    def batch_of(pid: int, safe: bool, masks: np.ndarray, size: int) -> pa.RecordBatch:
        n = len(masks)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, pid)), pa.array(np.full(n, safe)), pa.array(masks), pa.array(np.full(n, size, np.int32))], names=names)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pid, tbit, edges in zip(*(batch.column(c).to_pylist() for c in ("pid", "tbit", "unique")), strict=True):
                size, masks, safe = smallest_masks(tbit, np.array(edges, np.int64), FRONTIER)
                yield batch_of(pid, safe, masks, size)

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pid, masks = batch.column("pid").to_numpy(), batch.column("mask").to_numpy()
            for own in np.unique(pid):
                at = np.flatnonzero(pid == own)
                tbit, edges, size = (batch.column(c)[int(at[0])].as_py() for c in ("tbit", "unique", "size"))
                safe, more = wider_masks(tbit, np.array(edges, np.int64), masks[at])
                yield batch_of(own, True, safe, size)
                yield batch_of(own, False, more, size + 1)

    level = scratch.put(problems.repartition(_parts(model), "pid").mapInArrow(begin, schema), "size0")
    best, step = None, 0
    while True:
        won = level.filter("safe").groupBy("pid").agg(F.min("mask").alias("mask"), F.first("size").alias("mask_size"), F.count(F.lit(1)).alias("n_optima"))
        best = won if best is None else best.unionByName(won)
        rest = level.filter("not safe").join(won.select("pid"), "pid", "left_anti")
        if rest.isEmpty():
            break
        step += 1
        level = scratch.put(rest.join(problems, "pid").repartition(_parts(model), "pid", "mask").mapInArrow(go_on, schema).distinct(), f"size{step}")
    solved = scratch.put(problems.join(best, "pid").drop("pid"), "solved")
    return rows.join(solved, ["tbit", "unique"]).select(*lead, "mask", "mask_size", "n_optima").withColumn("names", bits_to_names(F.col("mask"), F.col("names")))


def program_lines(model: DataFrame) -> DataFrame:
    """(dataset, target, line_no, line): the integer program of the smallest mask in LP text form.

    Cell 0 is the target, cell i + 1 attribute i. a: deleted, r: known. Visible cells are known, the target isn't, and of every edge
    (parallel ones once) the last unknown cell becomes known.
    """
    # The names of the program's rows and variables, as its text form has them.
    cells = F.sequence(F.lit(0), F.col("n"))
    number = lambda i: F.when(i == F.col("n"), 0).otherwise(i + 1)  # noqa: E731  bit -> cell
    unique = F.array_sort(F.array_distinct(F.transform("edges", lambda e: e["mask"])))
    members = lambda m: F.array_sort(F.transform(F.filter(cells, lambda i: F.getbit(m, i) == 1), number))
    rows = model.withColumn("lists", F.transform(unique, members))
    text = lambda c: c.cast("string")

    def closing(m: Column, e: Column) -> Column:
        def one(h: Column) -> Column:
            tail = F.transform(F.filter(m, lambda y: y != h), lambda y: F.concat(F.lit(" - r"), text(y)))
            return F.concat(F.lit(" closure_e"), text(e), F.lit("_h"), text(h), F.lit(": r"), text(h), F.array_join(tail, ""), F.lit(" >= "), text(2 - F.size(m)))

        return F.transform(m, one)

    lines = F.concat(
        F.array(F.lit("Minimize"), F.concat(F.lit("  "), F.array_join(F.transform(cells, lambda i: F.concat(F.lit("a"), text(i))), " + ")), F.lit("Subject To")),
        F.transform(cells, lambda i: F.concat(F.lit(" visible_implies_known_"), text(i), F.lit(": a"), text(i), F.lit(" + r"), text(i), F.lit(" >= 1"))),
        F.array(F.lit(" target_not_inferable: r0 = 0")),
        F.flatten(F.transform("lists", closing)),
        F.array(F.lit("Bounds"), F.lit(" a0 = 1"), F.lit("Binaries"), F.concat(F.lit(" "), F.array_join(F.transform(cells, lambda i: F.concat(F.lit("a"), text(i), F.lit(" r"), text(i))), " ")), F.lit("End")),
    )
    return rows.select("dataset", "target", F.posexplode(lines).alias("line_no", "line"))


def exponential_mask(model: DataFrame, table: DataFrame, epsilon: float, cap: float, *, penalty: float = 1000.0, method: str = "greedy_disjoint", seed: int | None = None) -> DataFrame:
    """One private choice among all masks for each model."""
    at = points(model.sparkSession, [epsilon], [cap])
    return gumbel_draw(probabilities(all_mask_candidates(table, model, method), at, penalty=penalty), 1, seed).join(model.select("dataset", "target", "names"), ["dataset", "target"]).withColumn("names", bits_to_names(F.col("mask"), F.col("names")))


def prefix_mask(model: DataFrame, scratch: Scratch, epsilon: float, cap: float, *, penalty: float = 1000.0, ordering: str = "greedy", method: str = "greedy_disjoint", seed: int | None = None) -> DataFrame:
    """One private choice among the prefixes for each model."""
    at = points(model.sparkSession, [epsilon], [cap])
    found = prefix_candidates(model, scratch, None, ordering, method, 7 if seed is None else seed)
    return gumbel_draw(probabilities(found, at, penalty=penalty), 1, seed).join(model.select("dataset", "target", "names"), ["dataset", "target"]).withColumn("names", bits_to_names(F.col("mask"), F.col("names")))
