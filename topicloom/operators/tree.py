"""Cluster, topic and word trees as leaf rows ``tree, path, ord, size``.

``path`` holds the names below the root, ``ord`` the position of each of them among its siblings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import percent_text
from .scan import HOT_ROWS, Running, ordered_scan


def tree_totals(leaves: DataFrame) -> DataFrame:
    """Size sum and leaf count of every node, the root included, for trees of any depth.

    Each leaf adds to all of its prefixes; the sums are formed before the shuffle.
    """
    depth = F.explode(F.sequence(F.lit(0), F.size("path"))).alias("depth")
    prefixes = leaves.select("tree", "path", "size", depth)
    node = prefixes.select("tree", "depth", F.slice("path", F.lit(1), F.col("depth")).alias("path"), "size")
    return node.groupBy("tree", "depth", "path").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("count"))


def layout(leaves: DataFrame, depth: int, mode: str = "size", hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Start ``x`` and width ``dx`` of every node; the leaves' positions have up to ``depth`` entries.

    The running sum of the leaf values in tree order gives where each leaf starts. A node starts
    with its first leaf and is as wide as its leaves together.
    """
    value = F.col("size") if mode == "size" else F.lit(1.0)
    rows = leaves.select("tree", "path", "ord", value.cast("double").alias("value"))
    order = [F.get(F.col("ord"), F.lit(d)) for d in range(depth)]
    started = ordered_scan(
        rows, ["tree"], order, {"left": Running("sum", F.col("value"), "before")}, hot_rows
    )
    each = started.select(
        "tree", "path", "value", F.coalesce("left", F.lit(0.0)).alias("left"),
        F.explode(F.sequence(F.lit(0), F.size("path"))).alias("depth"),
    )
    nodes = each.groupBy("tree", "depth", F.slice("path", F.lit(1), F.col("depth")).alias("path")).agg(
        F.min("left").alias("left"), F.sum("value").alias("value")
    )
    root = rows.groupBy("tree").agg(F.sum("value").alias("root"))
    return nodes.join(root, "tree").select(
        "tree", "path", "depth", (F.col("left") / F.col("root")).alias("x"), "value",
        (F.col("value") / F.col("root")).alias("dx"),
    )


def zoom(nodes: DataFrame, x: float | Column, dx: float | Column, depth: int | Column) -> DataFrame:
    """Nodes that start inside ``[x, x + dx)`` at or below ``depth``."""
    x = x if isinstance(x, Column) else F.lit(x)
    dx = dx if isinstance(dx, Column) else F.lit(dx)
    return nodes.where((F.col("x") >= x) & (F.col("x") < x + dx) & (F.col("depth") >= depth))


def path_sums(df: DataFrame, path: list[str], depth: str, value: str, limit: int | None = None) -> DataFrame:
    """Running sum down a path; ``limit`` keeps the first nodes only. A path is a tree's depth long."""
    w = Window.partitionBy(*path).orderBy(depth).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("acc", F.sum(value).over(w))
    return rows if limit is None else rows.where(F.row_number().over(Window.partitionBy(*path).orderBy(depth)) <= limit)


def node_percent(totals: DataFrame) -> DataFrame:
    """Share of the root as text for every node."""
    roots = totals.where(F.col("depth") == 0).select("tree", F.col("size").alias("__root"))
    return totals.join(roots, "tree").withColumn("percent", percent_text(F.col("size"), F.col("__root"))).drop("__root")


def rollup_totals(rows: DataFrame, levels: list[str], size: str) -> DataFrame:
    """Node totals of a table with one column per level, by rollup."""
    return rows.rollup(*levels).agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("count"), F.grouping_id().alias("gid"))
