"""The operators of this subpackage, applied to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm import oracles
from veilgraph.llm.annular_codes import compress
from veilgraph.llm.binary_packing import pack
from veilgraph.llm.chat_snapshots import collapse
from veilgraph.llm.cross_parse import held_out as language_held_out
from veilgraph.llm.cross_parse import identify, learn
from veilgraph.llm.curve_ann import nearest
from veilgraph.llm.decontaminate import decontaminate
from veilgraph.llm.digest_index import exact_dedup
from veilgraph.llm.jaccard_join import jaccard_join
from veilgraph.llm.quality import held_out as quality_held_out
from veilgraph.llm.quality import score_quality, train
from veilgraph.llm.seed_extend import seed_extend_dedup
from veilgraph.llm.spelling import spelling_variants, word_counts
from veilgraph.llm.suffix_dedup import suffix_dedup
from veilgraph.llm.url_trust import judge

#: Rules of the URL query: verdict, host and path.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _span_total(column: str = "spans"):
    return F.aggregate(column, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of documents that 200-byte repeats cover."""
    found = suffix_dedup(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", _span_total().alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of documents, and how many links each document has."""
    found = jaccard_join(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_shingles")


def op3_curve_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = _table(spark, sf_dir, "documents")
    return identify(docs, learn(docs)).select(F.col("id").alias("doc_id"), language_held_out("id").alias("held_out"), "lang_pred", "score")


def op5_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that documents share with benchmark items, in windows of 10."""
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return collapse(_table(spark, sf_dir, "conversations"))


def op8_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that repeats of 35 words cover."""
    found = seed_extend_dedup(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", _span_total().alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    docs = _table(spark, sf_dir, "documents")
    scored = score_quality(docs.select("doc_id", "text"), train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("row.doc_id", quality_held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and host trust for every page."""
    return judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of every vector, with integer codebooks of 4 parts and 256 entries."""
    return compress(_table(spark, sf_dir, "embeddings")).select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of documents with its form, its root and how many words are one edit away."""
    return spelling_variants(word_counts(_table(spark, sf_dir, "documents")))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document the one of its group of equal texts that stays."""
    found = exact_dedup(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def queries() -> dict:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_jaccard_join": op2_jaccard_join,
        "op3_curve_ann": op3_curve_ann,
        "op4_language_id": op4_language_id,
        "op5_binary_packing": op5_binary_packing,
        "op6_decontamination": op6_decontamination,
        "op7_chat_snapshots": op7_chat_snapshots,
        "op8_seed_extend": op8_seed_extend,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_url_filters": op10_url_filters,
        "op11_vector_codes": op11_vector_codes,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_exact_dedup": op13_exact_dedup,
    }


def oracle_sql() -> dict:
    return {
        "op1_suffix_dedup": oracles.SUFFIX_DEDUP,
        "op2_jaccard_join": oracles.JACCARD,
        "op6_decontamination": oracles.DECONTAMINATION,
        "op7_chat_snapshots": oracles.CHATS,
        "op8_seed_extend": oracles.SEED_EXTEND,
        "op11_vector_codes": oracles.VECTOR_CODES,
        "op12_spelling_variants": oracles.SPELLING,
        "op13_exact_dedup": oracles.EXACT_DEDUP,
    }
