"""Edges by insertion time are worked out once for each different set of late cells, and rows of small files reach all cores."""

from pyspark.sql import functions as F

from veilgraph.operators import hypergraph
from veilgraph.sources import constraints
from veilgraph.store import dealt


def test_keys_that_share_late_cells_share_a_model(spark):
    model = hypergraph.models(constraints.catalog(spark, ("airport",)))
    row = model.first()
    times = spark.range(60).select(F.lit("airport").alias("dataset"), F.col("id").alias("key"), F.map_from_arrays(F.array(*[F.lit(a) for a in [*row["names"], row["target"]]]), F.array(*[F.col("id") % 2] * row["n"], F.lit(1).cast("long"))).alias("times"))
    late = hypergraph.late_members(model, times)
    want = {k: row["tbit"] | (row["tbit"] - 1 if k % 2 else 0) for k in range(60)}
    assert {r.key: r.late for r in late.collect()} == want
    found = hypergraph.late_models(model, late).collect()
    assert sorted(r.late for r in found) == sorted(set(want.values()))
    every = {r.late: [(e.eid, e.mask & r.late) for e in row["edges"] if (e.mask & r.late).bit_count() > 1] for r in found}
    assert {r.late: [(e.eid, e.mask) for e in r.edges] for r in found} == every
    assert {r.key: [(e.eid, e.mask) for e in r.edges] for r in hypergraph.time_filtered(model, times).collect()} == {k: every[w] for k, w in want.items()}


def test_rows_of_one_file_are_dealt(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    rows = spark.read.parquet(f"{tmp_path}/one")
    assert rows.rdd.getNumPartitions() == 1
    assert dealt(rows).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in dealt(rows).collect()) == list(range(100))
