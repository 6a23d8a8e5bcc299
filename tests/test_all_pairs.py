"""A constraint without an equality over more rows than one task should compare."""

import pytest

from veilgraph.operators import pairs

DC = [(0, "a", "<", 1, "a"), (0, "b", ">", 1, "b")]


def test_many_rows_are_compared_and_not_refused(spark):
    rows = spark.range(20_500).selectExpr("id AS k", "id AS a", "CASE WHEN id = 7 THEN 9 WHEN id = 9 THEN 7 ELSE id END AS b")
    assert sorted(map(tuple, pairs.violations(rows, "k", DC).collect())) == [(7, 8), (7, 9), (8, 9)]


@pytest.mark.parametrize("sent", [0, 2_000_000])
def test_blocks_meet_each_other_once(spark, monkeypatch, sent):
    monkeypatch.setattr(pairs, "MOST_SENT", sent)
    monkeypatch.setattr(pairs, "BLOCK", 70, raising=False)
    data = [(i, i * 7 % 31 if i % 9 else None, i * 5 % 23) for i in range(300)]
    rows = spark.createDataFrame(data, "k long, a int, b int")
    want = sorted((x[0], y[0]) for x in data for y in data if x[1] is not None and y[1] is not None and x[1] < y[1] and x[2] > y[2])
    assert sorted(map(tuple, pairs.violations(rows, "k", DC).collect())) == want
