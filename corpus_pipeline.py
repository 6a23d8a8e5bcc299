"""A corpus pipeline: quality, near duplicates, repeated substrings, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm._repeats import identity
from veilgraph.store import Scratch
from veilgraph.llm.binary_packing import pack
from veilgraph.llm.decontaminate import decontaminate
from veilgraph.llm.jaccard_join import jaccard_join
from veilgraph.llm.quality import score_quality, train
from veilgraph.llm.queries import tokenizer_path
from veilgraph.llm.suffix_dedup import suffix_dedup

#: A document goes if benchmark windows cover more than this share of its words; else the windows go.
MOST_COVERED = 0.5


def _with_text(rows: DataFrame, carried: str, text: str, columns: list[str]) -> DataFrame:
    """The documents' columns in their order, with a new text (and its length, where n_chars is given)."""

    def one(name: str):
        if name == "text":
            return F.col(text).alias(name)
        if name == "n_chars":
            return F.length(text).cast("long").alias(name)
        return F.col(f"{carried}.`{name}`").alias(name)

    return rows.select(*[one(c) for c in columns])


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c != "text"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more; without labelled rows all stay. Null and empty texts are scored as empty."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).filter("score >= 0.5").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that with the least id. Rows that agree in id and text are one. Texts without words stay."""
    keepers = jaccard_join(docs).filter("keeper").select("d", "t").distinct()
    rows = docs.select(*identity(docs, "doc_id", "text"), F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"))
    return rows.join(keepers, ["d", "t"], "left_semi").dropDuplicates(["d", "t"]).select("row.*")


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated strings of 200 bytes; documents of which nothing is left go, empty ones stay."""
    found = suffix_dedup(docs, carry=_others(docs), as_text=True)
    return _with_text(found.filter("n_bytes = 0 or kept != ''"), "carried", "kept", docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that benchmark windows cover; documents that they mostly consist of go."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=_others(docs))
    return _with_text(found.filter(F.col("n_hit") <= MOST_COVERED * F.col("n_words")), "carried", "clean", docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length of all documents that are left."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_substrings", repeated_substrings),
    ("benchmark_leaks", benchmark_leaks),
    ("packing", packing),
]

#: Trained weights and token ids are beyond SQL; tests/llm/test_pipeline.py holds every stage against all pairs, all windows and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
