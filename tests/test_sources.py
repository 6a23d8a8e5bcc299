"""Readers of constraints, datasets and run records."""

import pytest
from pyspark.sql import functions as F

from veilgraph.sources import constraints as C
from veilgraph.sources import datasets as D
from veilgraph.sources import runs as R


def lines(spark, *text):
    return spark.createDataFrame([(t,) for t in text], "value string").coalesce(1)


def preds(df):
    return [[tuple(p) for p in r.preds] for r in df.orderBy("dc_id").collect()]


def test_text(spark):
    got = C.parse_text(lines(spark, "not (t1.a-b<>t2.a-b and t1.c>=t2.c)", "# skipped", "", "  not(t1.x==t2.y)"))
    assert preds(got) == [[(0, "a-b", "!=", 1, "a-b"), (0, "c", ">=", 1, "c")], [(0, "x", "==", 1, "y")]]


def test_json_lines_keep_one_to_three_predicates(spark):
    p = '{"column1":{"columnIdentifier":"a str"},"index1":0,"op":"EQUAL","column2":{"columnIdentifier":"b int"},"index2":1}'
    q = p.replace('"index2":1', '"index2":2')
    got = C.parse_json_lines(lines(spark, f'{{"predicates":[{p}]}}', f'{{"predicates":[{q}]}}', f'{{"predicates":[{p},{p},{p},{p}]}}', "", "no json", '{"predicates":[]}'))
    assert preds(got) == [[(0, "a", "==", 1, "b")]] and got.first().dc_id == 1
    assert C.parse_json_lines(lines(spark, f'{{"predicates":[{p},{p},{p},{p}]}}'), most=None).count() == 1


def test_literals_and_column_names(spark):
    got = C.parse_literals(lines(spark, "[('t1.area_code', '==', 't2.area_code'), ('t1.state', '!=', 't2.state')],", "denial_constraints = ["), columns=C.TAX_COLUMNS)
    assert preds(got) == [[(0, "AreaCode", "==", 1, "AreaCode"), (0, "State", "!=", 1, "State")]]


def test_weighted_rows(spark):
    rows = spark.createDataFrame([("t0.A-b str EQUAL t1.A-b str AND t0.c LESS t1.c", 0.5), ("t0.x EQUAL t1.x", 0.0)], "dc_str string, weight double").coalesce(1)
    assert C.weighted_columns(["dataset", "dc_id", "dc_str", "weight"]) == ("dc_str", "weight")
    assert C.weighted_columns(["rule", "x"]) == ("rule", "x")
    assert preds(C.parse_weighted(rows)) == [[(0, "a_b", "==", 1, "a_b"), (0, "c", "<", 1, "c")]]


def test_catalogs(spark):
    counts = {r.dataset: r.n for r in C.catalog(spark).groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {"airport": 7, "hospital": 39, "adult": 51, "flight": 112, "tax": 31}
    with pytest.raises(C.CatalogError):
        C.catalog_lines("nothing")


def test_weights_by_position(spark):
    dcs = C.parse_text(lines(spark, "not (t1.a==t2.a)", "not (t1.b==t2.b)"))
    assert [r.weight for r in C.with_weights(dcs, [0.1, 0.2, 9.0]).orderBy("dc_id").collect()] == [0.1, 0.2]
    for bad in (None, [], [0.1]):
        with pytest.raises(C.CatalogError):
            C.with_weights(dcs, bad)


def header(schema, suffix=""):
    return ",".join(f"{n}{suffix}" for n, _ in D._fields(schema))


def write(tmp_path, name, *rows):
    path = tmp_path / name
    path.write_text("\n".join(rows) + "\n", encoding="utf-8")
    return str(path)


def test_adult(spark, tmp_path):
    good = "39, Private ,77516,HS-grad,13,Never, ,Not,White,Male,0,0,40,US,<=50K"
    path = write(tmp_path, "adult.csv", "﻿" + header(D.ADULT).replace("_", "-").replace("age", "Age int"), good, good.replace("39", ""), good.replace("39", "x"))
    rows = D.load_adult(spark, path).collect()
    assert len(rows) == 1 and rows[0].id == 1 and rows[0].workclass == "Private" and rows[0].occupation == "" and rows[0].age == 39


def test_airport(spark, tmp_path):
    path = write(tmp_path, "airport.csv", header(D.AIRPORT, " str"), "K1,small,,40.5,,11,,US,,,no,,,,,,", "K2,big,Name,x,,,NA,US,,,no,,,,,,")
    a, b = D.load_airport(spark, path).orderBy("id").collect()
    assert (a.ident, a.name, a.latitude_deg, a.elevation_ft, a.continent) == ("K1", "", 40.5, 11, None)
    assert (b.latitude_deg, b.continent) == (None, "NA")


def test_hospital(spark, tmp_path):
    path = write(tmp_path, "h.csv", ",".join(f"c{i}" for i in range(16)), "1,A,,x,,,,,,,,,,,s,extra", "short,row", ",B,,,,,,,,,,,,,s,", "2,A,,,,,,,,,,,,,,")
    rows = D.load_hospital(spark, path).orderBy("id").collect()
    assert [(r.id, r.ProviderNumber, r.City, r.StateAvg) for r in rows] == [(1, "1", None, "s"), (2, "2", None, None)]


def test_tax(spark, tmp_path):
    names = header(D.TAX).replace("area_code", "AreaCode")
    path = write(tmp_path, "tax.csv", names, "A,B,M,,1,c,s,z,S,Y,12.9,3.5,NA,None,#", "," * 14, "C,,,,,,,,,,,,7,,")
    a, b = D.load_tax(spark, path).orderBy("id").collect()
    assert (a.salary, float(a.rate), a.single_exemp, a.married_exemp, a.child_exemp, a.area_code) == (12, 3.5, None, None, None, "")
    assert (b.fname, b.salary, b.single_exemp) == ("C", None, 7)


def test_flight_fails_on_bad_numbers(spark, tmp_path):
    row = "2020,1,1,1,3,2020-01-01,AA,1,AA,N1,10,1,2,3,JFK,New York,NY,36,New York,22"
    assert D.load_flight(spark, write(tmp_path, "f.csv", header(D.FLIGHT), row)).first().FlightNum == 10
    with pytest.raises(Exception):
        D.load_flight(spark, write(tmp_path, "g.csv", header(D.FLIGHT), row.replace("2020,1,", "2020,x,"))).collect()


def test_ids_are_dense(spark):
    df = spark.range(1000).select(F.col("id").alias("a")).repartition(7)
    assert sorted(r.id for r in D.with_ids(df, "a long").collect()) == list(range(1, 1001))


def test_registry_and_populate(spark, tmp_path):
    assert D.dataset("Flights").table == "flight_data" and D.dataset("airport").key == "id"
    with pytest.raises(ValueError):
        D.dataset("nope")
    path = write(tmp_path, "tax.csv", header(D.TAX), "A,B,M,,1,c,s,z,S,Y,1,3.5,1,1,1")
    for _ in range(2):
        out = D.populate(spark, {"tax": path}, str(tmp_path / "tables"))
    assert spark.read.parquet(out["tax"]).count() == 1


def test_runs(spark, tmp_path):
    names = [f.strip().split(" ")[0] for f in R.RUN.split(",")]
    (tmp_path / "exp").mkdir()
    write(tmp_path / "exp", "a.csv", ",".join(names), "exp,tax,city,0.1,1000,0.2,0.002,0,0,0.002,1.5,0.5,-3,1,3,619,3", "min,tax,city,,,,0.002,0,0,0.002,0,0.5,-3,1,3,619,3")
    got = R.read_runs(spark, str(tmp_path))
    assert got.count() == 2 and R.read_runs(spark, str(tmp_path), private_only=True).count() == 1
    at = R.at_point(got, 0.1, 0.2).first()
    assert (at.total_time, at.leakage) == (2.0, 1.0)
    R.extract_main(got, str(tmp_path / "main"))
    assert spark.read.parquet(str(tmp_path / "main")).count() == 2
    R.append_runs(got, str(tmp_path / "log"))
    R.append_runs(got, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    write(tmp_path, "bad.csv", "x,y", "1,2")
    with pytest.raises(ValueError):
        R.read_runs(spark, str(tmp_path / "bad.csv"))
    assert R.titled(spark.createDataFrame([("tax",)], "dataset string")).first()[0] == "Tax"
