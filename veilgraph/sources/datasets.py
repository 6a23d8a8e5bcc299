"""The five datasets from CSV files: names, types and rules for empty values of each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgraph.store import Scratch

#: The columns of the tables, after their id.
ADULT = "age int, workclass string, fnlwgt int, education string, education_num int, marital_status string, occupation string, relationship string, race string, sex string, capital_gain int, capital_loss int, hours_per_week int, native_country string, class string"
AIRPORT = "ident string, type string, name string, latitude_deg double, longitude_deg double, elevation_ft int, continent string, iso_country string, iso_region string, municipality string, scheduled_service string, gps_code string, iata_code string, local_code string, home_link string, wikipedia_link string, keywords string"
HOSPITAL = "ProviderNumber string, HospitalName string, City string, State string, ZIPCode string, CountyName string, PhoneNumber string, HospitalType string, HospitalOwner string, EmergencyService string, Condition string, MeasureCode string, MeasureName string, Sample string, StateAvg string"
TAX = "fname string, lname string, gender string, area_code string, phone string, city string, state string, zip string, marital_status string, has_child string, salary int, rate decimal(8,6), single_exemp int, married_exemp int, child_exemp int"
FLIGHT = "Year int, Quarter int, Month int, DayofMonth int, DayOfWeek int, FlightDate date, UniqueCarrier string, AirlineID int, Carrier string, TailNum string, FlightNum int, OriginAirportID int, OriginAirportSeqID int, OriginCityMarketID int, Origin string, OriginCityName string, OriginState string, OriginStateFips int, OriginStateName string, OriginWac int"
NCVOTER = "id int, voter_reg_num decimal(15,2), name_prefix string, first_name string, middle_name string, last_name string, name_suffix string, age int, gender string, race string, ethnic string, street_address string, city string, state string, zip_code string, full_phone_num string, birth_place string, register_date date, download_month string, party string"
NULL_WORDS = ("", "NA", "None", "#")


def _fields(schema: str) -> list[tuple[str, str]]:
    out, depth, now = [], 0, ""
    for ch in schema + ",":
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            name, kind = now.strip().split(" ", 1)
            out.append((name, kind))
            now = ""
        else:
            now += ch
    return out


def header_name(raw: str) -> str:
    """A header without byte order mark and type, in lower case with underscores."""
    words = raw.replace("﻿", "").split()
    return words[0].lower().replace("-", "_") if words else ""


def _raw(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All columns as text, under their plain header names. Where cells may hold line breaks a file can't be split, so each is one task's work."""
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").option("encoding", "UTF-8").option("nullValue", "\u0000").option("emptyValue", "").option("multiLine", multi_line).option("escape", '"').csv(path)
    return df.toDF(*[header_name(c) or f"column{i}" for i, c in enumerate(df.columns)])


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(f"`{name}`"), F.lit("")))


def _filled(name: str) -> Column:
    return F.nullif(_text(name), F.lit(""))


def _column(df: DataFrame, name: str) -> str:
    """The raw column of a table's column, whatever its case and underscores."""
    flat = lambda s: s.lower().replace("_", "")
    for c in df.columns:
        if flat(c) == flat(name):
            return c
    raise ValueError(f"the file has no column for {name!r}")


def with_ids(df: DataFrame, schema: str) -> DataFrame:
    """A dense id from 1 in input order: files by name, rows as they stand in them; rows that don't come from files by their partitions.

    The rows are written with their places first, so what is counted is what is numbered, and no task numbers all rows: a file's split is
    read by one task in order, and only the splits' sizes (a row for each) are added up.
    """
    names = [n for n, _ in _fields(schema)]
    place = F.monotonically_increasing_id()
    try:
        split = [F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b")]
        df.select(*split)
    except AnalysisException:
        split = [F.lit("").alias("__f"), F.shiftright(place, 33).alias("__b")]
    marked = Scratch(df.sparkSession).put(df.select(*names, *split, place.alias("__i")), "rows")
    sizes = marked.groupBy("__f", "__b").agg(F.count(F.lit(1)).alias("__n"), F.min("__i").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__f", "__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = marked.join(F.broadcast(sizes.select("__f", "__b", "__first", before.alias("__base"))), ["__f", "__b"])  # a row for each split
    return placed.select((F.col("__i") - F.col("__first") + F.col("__base") + 1).cast("int").alias("id"), *names)


def load_adult(spark: SparkSession, path: str) -> DataFrame:
    """Texts stay as they are, trimmed; a row whose numbers are missing or no whole numbers is dropped."""
    raw = _raw(spark, path)
    whole = [n for n, k in _fields(ADULT) if k == "int"]
    cols = [F.expr(f"try_cast(trim(`{_column(raw, n)}`) as int)").alias(n) if k == "int" else _text(_column(raw, n)).alias(n) for n, k in _fields(ADULT)]
    return with_ids(raw.select(*cols).dropna(subset=whole), ADULT)


def load_airport(spark: SparkSession, path: str) -> DataFrame:
    """Empty is null from latitude_deg on; the first three columns stay as they are. Quoted cells may hold line breaks."""
    raw = _raw(spark, path, True)
    cols = []
    for i, (n, k) in enumerate(_fields(AIRPORT)):
        c = _filled(_column(raw, n)) if i >= 3 else _text(_column(raw, n))
        cols.append((c if k == "string" else c.try_cast("double").cast(k)).alias(n))
    return with_ids(raw.select(*cols), AIRPORT)


def load_hospital(spark: SparkSession, path: str) -> DataFrame:
    """The first 15 columns by position, empty as null; short rows and rows without provider number are dropped."""
    names = [n for n, _ in _fields(HOSPITAL)]
    header = spark.read.option("header", True).csv(path)
    if len(header.columns) < len(names):
        raise ValueError(f"the file has {len(header.columns)} columns, fewer than {len(names)}")
    every = [*names, *[f"__extra{i}" for i in range(len(header.columns) - len(names))]]
    schema = ", ".join(f"`{n}` string" for n in [*every, "__broken"])
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("columnPruning", False).option("columnNameOfCorruptRecord", "__broken").csv(path)
    # a row with another number of cells than the header comes with its text
    cells = F.regexp_count(F.regexp_replace("__broken", '"[^"]*"', ""), F.lit(",")) + 1
    whole = F.col("__broken").isNull() | (cells >= len(names))
    return with_ids(raw.filter(whole).select(*[_filled(n).alias(n) for n in names]).filter("ProviderNumber is not null"), HOSPITAL)


def load_tax(spark: SparkSession, path: str) -> DataFrame:
    """Texts stay; numbers treat empty, NA, None and # as null and are cut towards zero; rows without any value are dropped."""
    raw = _raw(spark, path)
    cols, given = [], []
    for n, k in _fields(TAX):
        c = _text(_column(raw, n))
        given.append(c != "")
        number = F.when(c.isin(*NULL_WORDS), None).otherwise(c).try_cast("double")
        cols.append((c if k == "string" else number.cast("long").cast("int") if k == "int" else number.cast(k)).alias(n))
    some = given[0]
    for g in given[1:]:
        some |= g
    return with_ids(raw.filter(some).select(*cols), TAX)


def load_flight(spark: SparkSession, path: str) -> DataFrame:
    """Whole numbers must be whole numbers: any other text fails the load when the rows are read."""
    raw = _raw(spark, path)
    cols = []
    for n, k in _fields(FLIGHT):
        c = _text(_column(raw, n))
        cols.append((c.cast("int") if k == "int" else F.nullif(c, F.lit("")).cast(k) if k == "date" else c).alias(n))
    return with_ids(raw.select(*cols), FLIGHT)


@dataclass(frozen=True)
class Dataset:
    """Where a dataset's rows and constraints belong."""

    name: str
    table: str
    key: str
    schema: str
    load: Callable[[SparkSession, str], DataFrame] | None


REGISTRY = {
    d.name: d
    for d in (
        Dataset("adult", "adult_data", "id", ADULT, load_adult),
        Dataset("airport", "airports", "id", AIRPORT, load_airport),
        Dataset("hospital", "hospital_data", "id", HOSPITAL, load_hospital),
        Dataset("tax", "tax_data", "id", TAX, load_tax),
        Dataset("flight", "flight_data", "id", FLIGHT, load_flight),
        Dataset("ncvoter", "ncvoter_data", "id", NCVOTER, None),
    )
}


def dataset(name: str) -> Dataset:
    """A dataset by name; the plural and any case are accepted."""
    found = REGISTRY.get(name.lower()) or REGISTRY.get(name.lower().rstrip("s"))
    if found is None:
        raise ValueError(f"unknown dataset {name!r}; there are {', '.join(REGISTRY)}")
    return found


def populate(spark: SparkSession, files: dict[str, str], target: str) -> dict[str, str]:
    """Loads each file into a Parquet table under ``target`` (written over, so loading twice doubles nothing); returns their paths."""
    out = {}
    for name in REGISTRY:
        if name in files and REGISTRY[name].load is not None:
            out[name] = f"{target.rstrip('/')}/{REGISTRY[name].table}"
            REGISTRY[name].load(spark, files[name]).write.mode("overwrite").parquet(out[name])
    return out
