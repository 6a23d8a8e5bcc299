"""Constraints as hyperedges over attributes, and the part of them that a target's value can be inferred through.

A model is one row for each (dataset, target): ``names`` lists the zone's attributes in order, so attribute i is bit i of
every mask, and the target is the bit after them. ``edges`` is an array of (eid, mask, w) in constraint order; parallel
edges stay apart. A model is a few kilobytes whatever the size of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ZONE = 20


def hyperedges(constraints: DataFrame) -> DataFrame:
    """(dataset, dc_id, attrs, weight): the sorted attributes of each constraint; fewer than two make no edge."""
    attrs = F.array_sort(F.array_distinct(F.concat(F.transform("preds", lambda p: p["c1"]), F.transform("preds", lambda p: p["c2"]))))
    return constraints.select("dataset", "target", "dc_id", attrs.alias("attrs"), "weight").filter(F.size("attrs") >= 2)


def zones(edges: DataFrame, target: Column | None = None, *, lightest: float | None = None) -> DataFrame:
    """(dataset, target, names, edges) with attributes by name: what is reached from the target over shared edges.

    A round of the closure passes all edges; rounds end with the first that reaches nothing new. ``lightest`` (tau) drops edges that
    weigh more.
    """
    edges = edges if target is None else edges.withColumn("target", target)
    kept = edges if lightest is None else edges.filter(F.col("weight") <= lightest)
    rows = kept.groupBy("dataset", "target").agg(F.array_sort(F.collect_list(F.struct("dc_id", "attrs", "weight"))).alias("all"))
    passed = lambda z: F.aggregate("all", z, lambda s, e: F.when(F.arrays_overlap(s, e["attrs"]), F.array_union(s, e["attrs"])).otherwise(s))
    # a round that changes nothing is the last that is worked out
    state = lambda z, before: F.struct(z.alias("z"), (F.size(z) == before).alias("done"))
    reached = F.aggregate(
        F.sequence(F.lit(1), F.size("all")),
        state(F.array("target"), F.lit(0)),
        lambda now, _: F.when(now["done"], now).otherwise(F.get(F.transform(F.array(passed(now["z"])), lambda z: state(z, F.size(now["z"]))), 0)),
        lambda now: now["z"],
    )
    rows = rows.withColumn("reached", reached)
    return rows.select("dataset", "target", F.array_sort(F.array_except("reached", F.array("target"))).alias("names"), F.filter("all", lambda e: F.arrays_overlap(e["attrs"], F.col("reached"))).alias("edges"))


def models(constraints: DataFrame, target: Column | None = None, *, lightest: float | None = None) -> DataFrame:
    """(dataset, target, names, n, tbit, edges): the target's hypergraph with attributes as bits."""
    z = zones(hyperedges(constraints), target, lightest=lightest)
    order = F.concat("names", F.array("target"))
    bit = lambda a: F.call_function("shiftleft", F.lit(1).cast("long"), (F.array_position(order, a) - 1).cast("int"))
    coded = F.transform("edges", lambda e, i: F.struct(i.alias("eid"), F.aggregate(e["attrs"], F.lit(0).cast("long"), lambda m, a: m.bitwiseOR(bit(a))).alias("mask"), e["weight"].alias("w")))
    n = F.size("names")
    return z.select("dataset", "target", "names", n.alias("n"), F.call_function("shiftleft", F.lit(1).cast("long"), n).alias("tbit"), coded.alias("edges"))


def edge_rows(model: DataFrame) -> DataFrame:
    """(dataset, target, eid, emask, w): a row for each edge of each model."""
    return model.select("dataset", "target", F.explode("edges").alias("e")).select("dataset", "target", "e.eid", F.col("e.mask").alias("emask"), "e.w")


def active(edge: Column, cell: Column, known: Column) -> Column:
    """Whether an edge infers a cell: it holds the cell, and all its others are known."""
    return (edge.bitwiseAND(cell) != 0) & (edge.bitwiseAND(F.bitwise_not(known)).bitwiseAND(F.bitwise_not(cell)) == 0)


def unblocked(edge: Column, mask: Column, target: Column) -> Column:
    """Whether fewer than two cells of an edge are deleted, the target included."""
    return F.bit_count(edge.bitwiseAND(mask.bitwiseOR(target))) < 2


def late_members(model: DataFrame, times: DataFrame) -> DataFrame:
    """(dataset, key, late): the bits of the cells that are at least as new as the target.

    ``times``: (dataset, key, times), a map from attribute to insertion time; an attribute that isn't in it counts as 0.
    """
    joined = times.join(F.broadcast(model.select("dataset", "target", "names", "tbit")), "dataset")  # a model row for each dataset
    time_of = lambda a: F.coalesce(F.try_element_at("times", a), F.lit(0))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    # bound as a lambda's variable, the target's time is looked up once for a row and not once for each cell
    late = lambda at: F.aggregate(F.transform("names", lambda a, i: F.when(time_of(a) >= at, bit(i)).otherwise(F.lit(0).cast("long"))), F.col("tbit"), lambda m, x: m.bitwiseOR(x))
    return joined.select("dataset", "key", F.get(F.transform(F.array(time_of(F.col("target"))), late), 0).alias("late"))


def late_models(model: DataFrame, late: DataFrame) -> DataFrame:
    """(dataset, target, late, names, n, tbit, edges): the edges left for each different set of late cells, however many keys share it.

    A member older than the target leaves its edge; an edge with one member left, or none, goes.
    """
    left = F.transform("edges", lambda e: F.struct(e["eid"].alias("eid"), e["mask"].bitwiseAND(F.col("late")).alias("mask"), e["w"].alias("w")))
    joined = late.select("dataset", "late").distinct().join(F.broadcast(model), "dataset")
    return joined.select("dataset", "target", "late", "names", "n", "tbit", F.filter(left, lambda e: F.bit_count(e["mask"]) > 1).alias("edges"))


def time_filtered(model: DataFrame, times: DataFrame) -> DataFrame:
    """(dataset, target, key, names, n, tbit, edges): for each key the edges left of cells that are at least as new as the target."""
    late = late_members(model, times)
    return late.join(late_models(model, late), ["dataset", "late"]).select("dataset", "target", "key", "names", "n", "tbit", "edges")


def attribute_constraints(constraints: DataFrame) -> DataFrame:
    """(dataset, attr, labels): for each attribute the sorted labels (phi and the number from 1) of the constraints that use it."""
    each = hyper_members(constraints).select("dataset", "attr", "dc_id").distinct()
    return each.groupBy("dataset", "attr").agg(F.transform(F.array_sort(F.collect_list("dc_id")), lambda i: F.concat(F.lit("phi"), (i + 1).cast("string"))).alias("labels"))


def hyper_members(constraints: DataFrame) -> DataFrame:
    """(dataset, dc_id, attr): the left attributes of each constraint."""
    return constraints.select("dataset", "dc_id", F.explode(F.array_distinct(F.transform("preds", lambda p: p["c1"]))).alias("attr"))


def density(constraints: DataFrame) -> DataFrame:
    """(dataset, n_attrs, n_pairs, rho1): attribute pairs that share a constraint, over attributes."""
    pairs = F.flatten(F.transform("a", lambda x: F.transform(F.filter("a", lambda y: y > x), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    lists = constraints.select("dataset", F.array_distinct(F.transform("preds", lambda p: p["c1"])).alias("a"))
    v = lists.select("dataset", F.explode("a").alias("v")).groupBy("dataset").agg(F.countDistinct("v").alias("n_attrs"))
    e = lists.select("dataset", F.explode(pairs).alias("e")).groupBy("dataset").agg(F.countDistinct("e").alias("n_pairs"))
    return v.join(e, "dataset", "left").select("dataset", "n_attrs", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), (F.coalesce("n_pairs", F.lit(0)) / F.col("n_attrs")).alias("rho1"))
