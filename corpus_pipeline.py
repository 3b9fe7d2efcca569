"""From raw documents to packed training sequences, in five stages.

Each stage is a function of ``(spark, docs, sf_dir)``; :func:`run` writes what a stage returns as
Parquet below the shared folder and reads it again as the next stage's input. All but the last
return the columns of ``documents``. Null texts, empty tables and repeated rows are handled as the
operators say; a document that a stage empties or rejects goes, every other one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from topicloom.llm import alignment, cascade, cube, minmax, packing
from topicloom.llm.common import small, stored, texts
from topicloom.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PLACE = ["_metadata.file_path AS __file", "_metadata.row_index AS __row"]
TOKENIZER, END_ID = "word_bpe_49k.json", 2
REMEMBERED = 400_000  # words; executors have grown in the stages before


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects; the rules stop at the first rejection."""
    return cascade.keep(docs, "text").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common blocks go from the later document; a document of which nothing is left goes with them."""
    cut = alignment.drop_aligned(docs.select(*COLUMNS))
    left = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id. Repeated rows of a kept id stay."""
    found = minmax.near_duplicates(texts(docs))
    going = stored(found.where(~F.col("kept")).select("doc_id").distinct(), "near-copies")
    return docs.join(small(going), "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: each row appears as often as the mix takes it.

    A row is known by its place in the files it is read from, so repeated ids and rows without one are
    mixed each for itself. A table that is not read from files is stored first.
    """
    try:
        placed = docs.selectExpr(*COLUMNS, *PLACE)
    except AnalysisException:
        placed = stored(docs.select(*COLUMNS), "mixed").selectExpr(*COLUMNS, *PLACE)
    mixed = cube.mix(texts(placed, keep=["source", "__file", "__row"]), keep=("__file", "__row"))
    taken = mixed.where("copies > 0").select("copies", F.col("__file").alias("__in"), F.col("__row").alias("__at"))
    same = (F.col("__file") == F.col("__in")) & (F.col("__row") == F.col("__at"))
    many = placed.join(small(stored(taken, "taken")), same).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return many.select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    return packing.pack(texts(docs), tokenizer(TOKENIZER), END_ID, remembered=REMEMBERED)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Alignment, sampling and tokenizers have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: ``(doc_id, start, length, doc_tokens, sequence_id, offset, ids)``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
