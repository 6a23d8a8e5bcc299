"""Tables rewritten in place by file, and insertion times kept by a stream."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veilgraph.operators.file_table import FileTable, VersionError
from veilgraph.streaming.times import keep_newest_times, newest_times, times_by_key


@pytest.fixture
def people(spark, tmp_path):
    rows = spark.range(100).select("id", F.concat(F.lit("n"), "id").alias("name"), (F.col("id") % 7).alias("age"))
    kept = FileTable(spark, f"file://{tmp_path}/people", "id")
    assert kept.create(rows.repartitionByRange(10, "id")) == 0
    return kept


def test_only_files_with_requested_keys_are_rewritten(spark, people):
    before = people.files()
    assert len(before) == 10
    ask = spark.createDataFrame([(3, ["name"]), (5, ["AGE", "unknown"]), (5, ["name"]), (97, ["age"]), (1000, ["name"]), (None, ["name"])], "id long, names array<string>")
    assert people.delete_cells(ask) == 1
    after = people.files()
    assert len(set(before) - set(after)) == 2 and len(set(before) & set(after)) == 8
    got = {r.id: (r.name, r.age) for r in people.read().collect()}
    want = {i: (f"n{i}", i % 7) for i in range(100)} | {3: (None, 3), 5: (None, None), 97: ("n97", None)}
    assert got == want
    assert {r.id: r.name for r in people.read(0).collect()} == {i: f"n{i}" for i in range(100)}


def test_a_request_for_no_row_makes_no_version(spark, people):
    assert people.delete_cells(spark.createDataFrame([(-1, ["name"])], "id long, names array<string>")) == 0
    assert people.versions() == [0]


def test_versions_are_taken_back_and_forgotten(spark, people):
    people.delete_cells(spark.createDataFrame([(3, ["name"])], "id long, names array<string>"))
    assert people.roll_back(0) == 2 and people.read().filter("name is null").count() == 0
    people.delete_cells(spark.createDataFrame([(4, ["name"])], "id long, names array<string>"))
    assert people.vacuum() == 2  # the file of version 1, and the one that version 3 has written anew
    assert people.versions() == [3] and people.read().count() == 100 and people.read().filter("name is null").count() == 1
    with pytest.raises(VersionError, match="no version"):
        people.read(0)
    with pytest.raises(VersionError, match="already"):
        people.create(spark.range(3))


def test_a_failure_leaves_the_last_version(spark, people):
    before = people.files()
    bad = F.udf(lambda i: 1 // 0, "string")
    with pytest.raises(Exception):  # noqa: B017
        people._written(people.read().withColumn("name", bad("id")))
    assert people.files() == before and people.read().count() == 100
    # somebody else commits first
    people._commit(1, before)
    with pytest.raises(VersionError, match="somebody else"):
        people._commit(1, before)


def test_newest_times_over_several_batches(spark, tmp_path):
    day = datetime(2024, 5, 1)
    at = lambda d, h=0: day + timedelta(days=d, hours=h)
    batches = [
        [(1, "city", at(0)), (1, "city", at(0, 5)), (2, "zip", at(1)), (None, "zip", at(1)), (2, None, at(1)), (3, "zip", None)],
        [(1, "city", at(0, 2)), (1, "zip", at(2)), (2, "zip", at(1, 9))],
        [(1, "city", at(20)), (4, "zip", at(20))],
        [(2, "zip", at(3)), (5, "zip", at(1)), (4, "zip", at(21))],  # the first two are later than the watermark allows
    ]
    source, target, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    schema = "user long, cell string, ts timestamp"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        keep_newest_times(stream, "user", "cell", "ts", target, state).awaitTermination()
    got = {(r.key, r.attribute): r.time for r in newest_times(spark, target).collect()}
    assert got == {(1, "city"): at(20), (1, "zip"): at(2), (2, "zip"): at(1, 9), (4, "zip"): at(21)}
    wide = {r.insertionKey: (r.city, r.zip) for r in times_by_key(newest_times(spark, target), ["city", "zip"]).collect()}
    epoch = datetime(1970, 1, 1)
    assert wide[2] == (None, int((at(1, 9) - epoch).total_seconds())) and wide[1][0] == int((at(20) - epoch).total_seconds())
