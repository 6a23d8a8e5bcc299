"""The driver's contract."""

import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_flagship(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns[0] == "c_custkey"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", ["ingest_clean", "dc_parse_text", "dc_parse_json", "dc_direction_stats", "afd_discovery", "em_sample", "gum_order", "min_deletion", "mask_to_null", "tau_contour", "heatmap_pivot", "interpolation"])
def test_queries_match_their_oracles(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = E.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(E.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(row[names.index(c)] for c in columns) for row in found.fetchall()]
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    key = lambda row: [(v is None, str(v)) for v in row]
    number = lambda v: float(v) if type(v).__name__ == "Decimal" else v
    assert sorted(got, key=key) == sorted((tuple(map(number, r)) for r in want), key=key)
