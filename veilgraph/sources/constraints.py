"""Denial constraints from text, JSON lines, literal lists and weighted CSV files, and the built-in catalogs.

A constraint is (dc_id, preds): an array of (i1, c1, op, i2, c2), which says that no pair of rows t0, t1 fulfils all of
them. ``i1`` and ``i2`` are 0 or 1.
"""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.functions.expressions import OPERATORS, operator_of, plain_name

DATASETS = ("airport", "hospital", "adult", "flight", "tax")
PREDICATES = "array<struct<i1:int,c1:string,op:string,i2:int,c2:string>>"
#: The targets of the five catalogs, and the tax names of files and tables.
TARGETS = {"airport": "continent", "hospital": "ProviderNumber", "adult": "education", "flight": "FlightDate", "tax": "city"}
TAX_COLUMNS = {
    "fname": "FName", "lname": "LName", "gender": "Gender", "area_code": "AreaCode", "phone": "Phone", "city": "City",
    "state": "State", "zip": "Zip", "marital_status": "MaritalStatus", "has_child": "HasChild", "salary": "Salary",
    "rate": "Rate", "single_exemp": "SingleExemp", "married_exemp": "MarriedExemp", "child_exemp": "ChildExemp",
}

_PREDICATE = r"t(\d)\.([\w\-]+)\s*(==|!=|<>|<=|>=|<|>)\s*t(\d)\.([\w\-]+)"


class CatalogError(ValueError):
    """A catalog that is missing, empty or doesn't fit its constraints."""


def predicates_of_text(text: Column) -> Column:
    """The predicates of ``not (t1.a==t2.a and t1.b<>t2.b)``, or of a list of ``('t1.a', '==', 't2.a')``; null if there is none.

    ``<>`` is read as ``!=``; the first row is 0 whether files count from 0 or 1.
    """
    plain = F.regexp_replace(text, r"[',()\[\]]", " ")
    words = F.transform(F.regexp_extract_all(plain, F.lit(_PREDICATE), F.lit(0)), lambda p: F.split(F.regexp_replace(p, _PREDICATE, "$1 $2 $3 $4 $5"), " "))
    row = lambda w, i: F.get(w, F.lit(i)).cast("int")

    def of(words: Column) -> Column:
        found = lambda least: F.transform(words, lambda w: F.struct((row(w, 0) - least).alias("i1"), F.get(w, F.lit(1)).alias("c1"), operator_of(F.get(w, F.lit(2))).alias("op"), (row(w, 3) - least).alias("i2"), F.get(w, F.lit(4)).alias("c2")))
        return F.when(F.size(words) > 0, _once(F.array_min(F.transform(words, lambda w: F.least(row(w, 0), row(w, 3)))), found))

    return _once(words, of)


def _once(value: Column, use) -> Column:
    """``use`` of a value that, bound as a lambda's variable, is worked out once for a row and not at each mention."""
    return F.get(F.transform(F.array(value), use), 0)


def parse_text(lines: DataFrame, column: str = "value") -> DataFrame:
    """(dc_id, preds) of lines that begin with ``not``; others are skipped. ``dc_id`` counts lines within a file from 0, in file order."""
    marked = lines.select(F.trim(column).alias("line"), F.monotonically_increasing_id().alias("at")).filter(F.col("line").startswith("not"))
    return _numbered(marked.select("at", predicates_of_text(F.col("line")).alias("preds")).filter("preds is not null"))


def parse_directory(spark: SparkSession, path: str) -> DataFrame:
    """(source, dataset, dc_id, preds) of all constraint files of a folder; ``dc_id`` counts from 0 within a file, in its order.

    The dataset is the file's name without ``top`` and ``DCs`` (the whole name if nothing is left). A file is a catalog and
    is read as one text, so that its lines keep their order; files without a constraint give no row.
    """
    from pyspark.sql import Window

    files_ = spark.read.option("wholetext", True).text(path).select(F.substring_index(F.input_file_name(), "/", -1).alias("source"), "value")
    lines = files_.select("source", F.posexplode(F.split("value", r"\r?\n")).alias("at", "line")).withColumn("line", F.trim("line")).filter(F.col("line").startswith("not"))
    preds = lines.select("source", "at", predicates_of_text(F.col("line")).alias("preds")).filter("preds is not null")
    short = F.regexp_replace("source", "top|DCs", "")
    order = Window.partitionBy("source").orderBy("at")
    return preds.select("source", F.when(short == "", F.col("source")).otherwise(short).alias("dataset"), (F.row_number().over(order) - 1).alias("dc_id"), "preds")


def write_catalog(catalog_: DataFrame, path: str) -> None:
    """Constraints, with their weights where they have some, as JSON lines that ``read_catalog`` reads back."""
    catalog_.write.mode("overwrite").json(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_catalog`` wrote: dataset, target, dc_id, preds, weight."""
    return spark.read.schema(f"dataset string, target string, dc_id int, preds {PREDICATES}, weight double").json(path)


def _numbered(rows: DataFrame) -> DataFrame:
    """dc_id from the order of ``at``. Catalogs are short lists, so one task numbers them."""
    from pyspark.sql import Window

    return rows.select((F.row_number().over(Window.orderBy("at")) - 1).alias("dc_id"), "preds")


def parse_json_lines(lines: DataFrame, column: str = "value", most: int | None = 3) -> DataFrame:
    """(dc_id, preds) of JSON lines as dependency miners write them: 1 to ``most`` predicates, row indexes 0 or 1.

    Column names lose a type that follows a space; operators become symbols. ``dc_id`` counts the accepted lines from 1.
    """
    rows = lines.select(F.monotonically_increasing_id().alias("at"), predicates_of_json(F.col(column), most).alias("preds"))
    return _numbered(rows.filter("preds is not null")).withColumn("dc_id", F.col("dc_id") + 1)


def predicates_of_json(text: Column, most: int | None = 3) -> Column:
    """The predicates of one such line; null where they are too many, none, or about other rows than 0 and 1."""
    side = "struct<tableIdentifier:string,columnIdentifier:string>"
    found = F.from_json(F.trim(text), f"type string, predicates array<struct<type:string,column1:{side},index1:int,op:string,column2:{side},index2:int>>")["predicates"]
    fits = (F.size(found) >= 1) & F.forall(found, lambda p: p["index1"].isin(0, 1) & p["index2"].isin(0, 1))
    if most is not None:
        fits &= F.size(found) <= most
    name = lambda c: F.substring_index(F.trim(c["columnIdentifier"]), " ", 1)
    return F.when(fits, F.transform(found, lambda p: F.struct(p["index1"].alias("i1"), name(p["column1"]).alias("c1"), operator_of(p["op"]).alias("op"), p["index2"].alias("i2"), name(p["column2"]).alias("c2"))))


def parse_literals(lines: DataFrame, column: str = "value", columns: dict[str, str] | None = None, most: int | None = 3) -> DataFrame:
    """(dc_id, preds) of a literal list, a constraint a line; attribute names go through ``columns``, and sides count as rows 0 and 1."""
    rows = lines.select(F.monotonically_increasing_id().alias("at"), predicates_of_literal(F.col(column), columns, most).alias("preds"))
    return _numbered(rows.filter("preds is not null"))


def predicates_of_literal(text: Column, columns: dict[str, str] | None = None, most: int | None = 3) -> Column:
    """The predicates of one such line; null where there are none or too many."""
    mapped = F.create_map(*[F.lit(x) for pair in (columns or {"": ""}).items() for x in pair])
    rename = lambda c: F.coalesce(F.try_element_at(mapped, c), c)
    plain = lambda found: F.transform(found, lambda p: F.struct(F.lit(0).alias("i1"), rename(p["c1"]).alias("c1"), p["op"].alias("op"), F.lit(1).alias("i2"), rename(p["c2"]).alias("c2")))
    return _once(predicates_of_text(text), lambda found: plain(found) if most is None else F.when(F.size(found) <= most, plain(found)))


def weighted_columns(names: list[str]) -> tuple[str, str]:
    """The constraint's and the weight's column: the last name that holds dc or constraint (else the first), and the last that holds weight (else the last)."""
    dc = [n for n in names if "dc" in n.lower() or "constraint" in n.lower()]
    weight = [n for n in names if "weight" in n.lower()]
    return (dc or names[:1])[-1], (weight or names[-1:])[-1]


def parse_weighted(rows: DataFrame) -> DataFrame:
    """(dc_id, preds, weight) of a weight file's rows with a positive weight, numbered anew from 0.

    A predicate has three words (``t0.a EQUAL t1.a``) or five, with a type after each name; names become plain. Any other number
    of words, a side that isn't a row and a column, or an unknown operator fails when the rows are read.
    """
    from pyspark.sql import Window

    dc, weight = weighted_columns(rows.columns)
    kept = rows.select(F.monotonically_increasing_id().alias("at"), F.col(f"`{dc}`").alias("dc"), F.col(f"`{weight}`").cast("double").alias("weight")).filter("weight > 0")
    return kept.select((F.row_number().over(Window.orderBy("at")) - 1).alias("dc_id"), predicates_of_weighted(F.col("dc")).alias("preds"), "weight")


def predicates_of_weighted(text: Column) -> Column:
    """The predicates of a weight file's constraint."""
    side = lambda x: F.struct(F.regexp_extract(x, r"^t(\d)\.", 1).try_cast("int").alias("i"), plain_name(F.substring_index(x, ".", -1)).alias("c"))

    def predicate(part: Column) -> Column:
        words = F.split(F.trim(part), r"\s+")
        five = F.size(words) == 5
        left, op, right = F.get(words, F.lit(0)), F.when(five, F.get(words, F.lit(2))).otherwise(F.get(words, F.lit(1))), F.when(five, F.get(words, F.lit(3))).otherwise(F.get(words, F.lit(2)))
        a, b = side(left), side(right)
        sound = F.size(words).isin(3, 5) & a["i"].isNotNull() & b["i"].isNotNull() & operator_of(op).isin(*set(OPERATORS.values()))
        found = F.struct(a["i"].alias("i1"), a["c"].alias("c1"), operator_of(op).alias("op"), b["i"].alias("i2"), b["c"].alias("c2"))
        return F.when(F.coalesce(sound, F.lit(False)), found).otherwise(F.raise_error(F.concat(F.lit("not a predicate: "), part)))

    return F.transform(F.split(text, " AND "), predicate)


def to_text(preds: Column) -> Column:
    """A constraint as ``t0.a == t1.a AND ...``."""
    return F.array_join(F.transform(preds, lambda p: F.concat(F.lit("t"), p["i1"].cast("string"), F.lit("."), p["c1"], F.lit(" "), p["op"], F.lit(" t"), p["i2"].cast("string"), F.lit("."), p["c2"])), " AND ")


def catalog_lines(dataset: str) -> list[tuple[float, str]]:
    """(weight, constraint) of a built-in catalog, in its order."""
    if dataset not in DATASETS:
        raise CatalogError(f"no catalog named {dataset!r}; there are {', '.join(DATASETS)}")
    text = (files("veilgraph.sources") / "catalogs" / f"{dataset}.txt").read_text()
    return [(float(w), dc) for w, dc in (line.split("\t") for line in text.splitlines() if line and not line.startswith("#"))]


def catalog(spark: SparkSession, datasets: tuple[str, ...] = DATASETS) -> DataFrame:
    """(dataset, target, dc_id, preds, weight) of built-in catalogs. Equal constraints take the first one's weight."""
    from pyspark.sql import Window

    rows = [(d, TARGETS[d], i, w, dc) for d in datasets for i, (w, dc) in enumerate(catalog_lines(d))]
    lines = spark.createDataFrame(rows, "dataset string, target string, dc_id int, weight double, line string")
    parsed = lines.select("dataset", "target", "dc_id", predicates_of_text(F.col("line")).alias("preds"), "weight")
    same = Window.partitionBy("dataset", "preds").orderBy("dc_id")
    return parsed.withColumn("weight", F.first("weight").over(same))


def with_weights(constraints: DataFrame, weights: list[float] | None) -> DataFrame:
    """Constraints with the weight at their position; surplus weights are ignored, too few or none is an error."""
    if weights is None:
        raise CatalogError("the weights are None")
    if not weights:
        raise CatalogError("there are no weights")
    n = constraints.agg(F.max("dc_id")).first()[0]
    if n is not None and n >= len(weights):
        raise CatalogError(f"constraint {n} has no weight; there are {len(weights)}")
    return constraints.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("dc_id")))
