"""A line's predicates are worked out once for each place that reads them, and not once for each mention of a part."""

from pyspark.sql import functions as F

from veilgraph.sources import constraints


def test_patterns_are_searched_few_times_in_a_line(spark):
    lines = ["[('t1.area_code', '==', 't2.zip'), ('t1.state', '<>', 't2.state')],", "# none", "not(t2.a-b<=t1.c)", None, "[('t1.a','<','t1.b'),('t1.a','<','t1.b'),('t1.a','<','t1.b'),('t1.a','<','t1.b')]"]
    rows = spark.createDataFrame([(x,) for x in lines], "value string").repartition(2)
    preds = constraints.predicates_of_literal(F.col("value"), constraints.TAX_COLUMNS)
    parsed = rows.select(preds.alias("preds")).filter("preds is not null").select(constraints.to_text(F.col("preds")).alias("dc"))
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 2
    assert sorted(r.dc for r in parsed.collect()) == ["t0.AreaCode == t1.Zip AND t0.State != t1.State", "t0.a-b <= t1.c"]
    text = rows.select(constraints.to_text(constraints.predicates_of_text(F.col("value"))).alias("dc")).filter("dc is not null")
    assert sorted(r.dc for r in text.collect()) == sorted(["t0.area_code == t1.zip AND t0.state != t1.state", "t1.a-b <= t0.c", " AND ".join(["t0.a < t0.b"] * 4)])
