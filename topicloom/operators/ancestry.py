"""Ancestors from parent links, for trees of any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def _jumps(links: DataFrame, node: str, parent: str) -> DataFrame:
    """``(node, up)``: every node once; a parent that is no node itself is a root."""
    own = links.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(parent).alias("up"))
    roots = own.where(F.col("up").isNotNull()).select(F.col("up").alias("node")).distinct().join(own.select("node"), "node", "left_anti")
    return materialise(own.unionByName(roots.select("node", F.lit(None).cast(own.schema["up"].dataType).alias("up"))), "parents")


def cyclic_nodes(links: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """``(node)``: nodes from which the parent links lead into a cycle."""
    return _settled(_jumps(links, node, parent))[1]


def _settled(jumps: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The tables of jumps by 1, 2, 4, .. links, and the nodes that lead into a cycle.

    Beyond the first, a table holds only nodes with so many ancestors. A chain of that length or more that
    ends has one node with just so many, which the next table lacks. So where the next table has as many
    rows, no such chain is left, and all its nodes lead into a cycle.
    """
    levels, now = [jumps], jumps.where(F.col("up").isNotNull())
    count, before = now.count(), None
    while count and count != before:
        far = now.select(F.col("node").alias("__at"), F.col("up").alias("__next"))
        now = materialise(now.join(far, F.col("up") == F.col("__at")).select("node", F.col("__next").alias("up")), "jumps")
        levels.append(now)
        before, count = count, now.count()
    return levels, now.select("node")


def ancestor_pairs(links: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """``(node, ancestor, distance)`` for every ancestor of every node, by doubling of pointers.

    ``links`` holds one row per node, ``parent`` null for a root; of several parents the least counts.
    A round knows all ancestors up to a distance and joins them to the pointers of that distance, so a
    tree of depth ``d`` takes ``log2 d`` rounds. Nodes that lead into a cycle have no row here, see
    :func:`cyclic_nodes`.
    """
    levels, looping = _settled(_jumps(links, node, parent))
    sound = levels[0].join(looping, "node", "left_anti")
    known = sound.where(F.col("up").isNotNull()).select("node", F.col("up").alias("ancestor"), F.lit(1).cast("bigint").alias("distance"))
    known, reach = materialise(known, "ancestors"), 1
    for jump in levels:
        # a node's ancestors beyond the reach are those within the reach of the node that its pointer leads to
        far = jump.where(F.col("up").isNotNull()).join(looping, "node", "left_anti").select("node", F.col("up").alias("__mid"))
        on = known.select(F.col("node").alias("__of"), "ancestor", "distance")
        more = materialise(far.join(on, F.col("__mid") == F.col("__of")).select("node", "ancestor", (F.col("distance") + reach).alias("distance")), "farther")
        if more.isEmpty():
            break
        known, reach = known.unionByName(more), 2 * reach
    return known
