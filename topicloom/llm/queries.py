"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, backtrack, cascade, conversation, ctw, cube, merkle, minmax, oph, packing, piece_count, quality, toxicity, twins
from .common import texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold_of() -> Column:
    """Remainder of the id's checksum, by which the contracts hold documents out."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5))


@query
def op1_ctw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ctw.score(documents(spark, sf_dir), fold_of() != 1)
    return scored.withColumn("held_out", fold_of() == 1)


@query
def op3_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oph.fingerprint_report(documents(spark, sf_dir))


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_count.count_tokens(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


@query
def op10_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = cube.mix(texts(docs, keep=["source"]))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


@query
def op7_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minmax.near_duplicates(documents(spark, sf_dir), width=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept", "class_id")


@query
def op2_aligned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    whole = docs.withColumn("n_lines", F.size(F.split("text", "\n")))
    return alignment.drop_aligned(whole).select("doc_id", "text", "n_lines", "n_removed")


def _classified(spark: SparkSession, sf_dir: str, classify, threshold: float) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = classify(documents(spark, sf_dir), labels, fold_of() != 0)
    return scored.select("doc_id", (fold_of() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, toxicity.classify, 0.5)


@query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, quality.classify, 0.3)


@query
def op11_butterfly_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query
def op12_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtrack.round_trip(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation.report(conversation.damage(rows), rows)


SQL["op6_quality_rules"] = twins.RULES
SQL["op7_minmax_near_duplicates"] = twins.NEAR
SQL["op11_butterfly_manifest"] = twins.MANIFEST
SQL["op13_conversation_repair"] = twins.REPAIR
