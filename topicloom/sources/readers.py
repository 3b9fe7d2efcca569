"""Readers of the corpus inputs, with explicit schemas.

All are lazy but those that number lines by their place in the files (:func:`file_lines`), which store
the lines, and :func:`read_tree`, which stores the nodes of each level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import split_line
from ..operators.joins import measured
from ..session import materialise


def read_meta(spark: SparkSession, path: str, fmt: str = "avro", schema: T.StructType = schemas.META) -> DataFrame:
    """Document metadata. Avro needs the spark-avro package on the class path."""
    return spark.read.format(fmt).schema(schema).load(path)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """Delimited text without a header; fields that do not parse become null."""
    return spark.read.csv(path, schema=schema, sep=sep, header=False, mode="PERMISSIVE")


def read_tuples(spark: SparkSession, path: str, k: int) -> DataFrame:
    """Lines ``(id,(w1,..,wk))`` as ``doc_id, weights``; a weight that does not parse is null."""
    fields = F.split(F.regexp_replace("value", r"[()\[\]\s]", ""), ",")
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(fields.alias("f"))
    return lines.select(
        F.get("f", F.lit(0)).try_cast("bigint").alias("doc_id"),
        F.transform(F.slice("f", 2, k), lambda v: v.try_cast("double")).alias("weights"),
    )


def weights_wide(df: DataFrame, k: int) -> DataFrame:
    """``C1..Ck`` columns from the weight array."""
    return df.select("doc_id", *[F.get("weights", F.lit(i)).alias(f"C{i + 1}") for i in range(k)])


def weights_long(df: DataFrame) -> DataFrame:
    """One ``(doc_id, topic, weight)`` row per entry of the weight array."""
    return df.select("doc_id", F.posexplode("weights").alias("topic", "weight"))


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ``id, word, count`` lines, blanks around a line removed."""
    lines = spark.read.text(path).select(split_line(F.col("value")).alias("f"))
    return lines.select(
        F.get("f", F.lit(0)).try_cast("bigint").alias("word_id"),
        F.get("f", F.lit(1)).alias("word"),
        F.get("f", F.lit(2)).try_cast("bigint").alias("count"),
    ).where(F.col("word_id").isNotNull())


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, line)``: lines that are not blank, numbered from 0 in the order of file names, then of places in a file.

    A line's number is its place in its part of a file plus the lines in the parts before. Lines are
    stored with their place and never shuffled; only the counts of parts are sorted.
    """
    placed = materialise(spark.read.text(path).where(F.length(F.trim("value")) > 0).select(
        "value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__at"),
    ), "lines")
    parts = placed.groupBy(F.col("__file").alias("__f"), F.col("__start").alias("__s")).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    order = Window.orderBy("__f", "__s").rowsBetween(Window.unboundedPreceding, -1)  # one row per part of a file
    starts = materialise(parts.select("__f", "__s", "__first", F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__before")), "parts")
    met = placed.join(measured(starts, 100_000), (F.col("__file") == F.col("__f")) & (F.col("__start") == F.col("__s")))
    return met.select("value", (F.col("__at") - F.col("__first") + F.col("__before")).alias("line"))


def read_matrix(spark: SparkSession, path: str, sep: str = ",", row_id: bool = False) -> DataFrame:
    """Dense matrix text as ``(row, col, value)``.

    With ``row_id`` the first field of a line is its row number. Without it rows are numbered by
    their place in the files: file name, start of the split, order inside the split.
    """
    lines = spark.read.text(path) if row_id else file_lines(spark, path)
    fields = F.split(F.trim("value"), sep)
    if row_id:
        parsed = lines.select(
            F.get(fields, F.lit(0)).try_cast("bigint").alias("row"),
            F.slice(fields, F.lit(2), F.greatest(F.size(fields) - 1, F.lit(0))).alias("f"),
        )
    else:
        parsed = lines.select(F.col("line").alias("row"), fields.alias("f"))
    cells = parsed.select("row", F.posexplode("f").alias("col", "text"))
    return cells.select("row", "col", F.col("text").try_cast("double").alias("value"))


def read_matrix_json(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """JSON map ``{"topic_0": [..], ..}`` as ``(i, j, sim)``.

    By default each line is such a map, so a large matrix is one line per row. ``whole`` reads a
    single pretty-printed document.
    """
    raw = spark.read.text(path, wholetext=whole)
    maps = raw.select(F.from_json("value", "MAP<STRING, ARRAY<DOUBLE>>").alias("m"))
    rows = maps.select(F.explode("m").alias("name", "cells"))
    number = F.regexp_extract("name", r"(\d+)$", 1).try_cast("int")
    return rows.select(number.alias("i"), F.posexplode("cells").alias("j", "sim"))


def read_tree(spark: SparkSession, path: str, whole: bool = False, children: str = "children", name: str = "name", size: str = "size") -> DataFrame:
    """Nested ``{name, children}`` documents of any depth as leaves ``(path, ord, name, size)``.

    By default each line is one subtree below the root. ``whole`` reads a single document, also one that
    is wrapped in ``data``; its root is left out. ``path`` holds the names on the way down, the leaf's
    included, ``ord`` the positions. A node without children is a leaf, at any level; its size may be
    missing. A line that is not valid gives no leaf.

    Nodes are unfolded level by level until none has children, one round for each level.
    """
    if whole:
        tree = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("t"))
        root = F.coalesce(F.try_variant_get("t", "$.data", "variant"), F.col("t"))
        top = tree.select(F.posexplode(F.try_variant_get(root, f"$.{children}", "array<variant>")).alias("__i", "node"))
    else:
        top = file_lines(spark, path).select(F.col("line").alias("__i"), F.try_parse_json("value").alias("node")).where(F.col("node").isNotNull())
    called = F.try_variant_get("node", f"$.{name}", "string")
    level = materialise(top.select(F.array(called).alias("path"), F.array(F.col("__i").cast("bigint")).alias("ord"), "node"), "nodes")
    leaves = []
    while True:
        below = F.try_variant_get("node", f"$.{children}", "array<variant>")
        found = F.when(F.size(below) > 0, below)
        leaves.append(level.where(found.isNull()).select("path", "ord", called.alias("name"), F.try_variant_get("node", f"$.{size}", "double").alias("size")))
        each = level.where(found.isNotNull()).select("path", "ord", F.posexplode(found).alias("__i", "node"))
        level = each.select(F.concat("path", F.array(called)).alias("path"), F.concat("ord", F.array(F.col("__i").cast("bigint"))).alias("ord"), "node")
        level = materialise(level, "nodes")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, leaves)
