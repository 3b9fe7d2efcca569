"""Equi joins of the corpus tables and keyed comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000


def small_side(table: DataFrame, max_rows: int | None) -> DataFrame:
    """Ask for a broadcast only if the caller knows a bound on the rows and the bound is small.

    Without a bound the engine decides by measured size, and splits skewed join partitions.
    """
    return F.broadcast(table) if max_rows is not None and max_rows <= BROADCAST_ROWS else table


def measured(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Ask for a broadcast of a stored table of narrow rows if it has at most ``rows`` of them, counted first."""
    return F.broadcast(table) if table.count() <= rows else table


def with_metadata(doc_topic: DataFrame, meta: DataFrame, ident: str = "doc_id") -> DataFrame:
    """Document weights joined with document metadata, one row per document known to both."""
    return doc_topic.join(meta, ident, "inner")


def with_words(topic_word: DataFrame, vocab: DataFrame, ident: str = "word_id",
               max_words: int | None = None) -> DataFrame:
    """Topic-word rows with their vocabulary entry (inner)."""
    return topic_word.join(small_side(vocab, max_words), ident, "inner")


def lookup_words(rows: DataFrame, vocab: DataFrame, ident: str = "word_id",
                 max_words: int | None = None) -> DataFrame:
    """Word for each id. An id without an entry keeps its row with a null word."""
    return rows.join(small_side(vocab.select(ident, "word"), max_words), ident, "left")


def unmatched_ids(rows: DataFrame, vocab: DataFrame, ident: str = "word_id") -> DataFrame:
    """Ids that the vocabulary does not know, with their number of rows."""
    counted = rows.groupBy(ident).agg(F.count(F.lit(1)).alias("rows"))
    return counted.join(vocab.select(ident), ident, "left_anti")


def cluster_topic_words(cluster_cut: DataFrame, topic_cut: DataFrame) -> DataFrame:
    """Cut topics of each cluster with the cut words of each topic; a topic without words stays."""
    topics = cluster_cut.select("cluster", "topic", F.col("share").alias("topic_share"), F.col("rank").alias("topic_rank"))
    words = topic_cut.select("topic", "word_id", F.col("share").alias("size"), F.col("rank").alias("word_rank"))
    return topics.join(words, "topic", "left")


def keyed_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Match old and new rows by key: added, kept or removed."""
    o = old.select(*keys, F.col(value).alias("old_value"), F.lit(True).alias("__old"))
    n = new.select(*keys, F.col(value).alias("new_value"), F.lit(True).alias("__new"))
    status = (
        F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").otherwise("kept")
    )
    return o.join(n, keys, "full").withColumn("status", status).drop("__old", "__new")
