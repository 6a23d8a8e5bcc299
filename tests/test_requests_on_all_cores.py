"""The customers of the request records are read by all cores, whatever the file's parts."""

from veilgraph.operators import answers
from veilgraph.plans import source_queries


def test_request_rows_are_dealt(spark, monkeypatch):
    seen = []

    class Enough(Exception):
        pass

    def stop(rows, *args, **kw):
        seen.append((rows.rdd.getNumPartitions(), rows.count()))
        raise Enough

    monkeypatch.setattr(answers, "run_request", stop)
    monkeypatch.setattr(source_queries, "_leakage", lambda spark, sf: (t := spark.createDataFrame([("airport",)], "dataset string"), None, t))
    try:
        source_queries.request_records(spark, "/root/testdata/sf0.001")
    except Enough:
        pass
    n = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()
    assert seen == [(2 * spark.sparkContext.defaultParallelism, n)]
