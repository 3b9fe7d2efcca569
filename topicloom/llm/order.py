"""Positions of rows in ordered groups, where one group may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored

PART_ROWS = 100_000


def positions(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """``df`` (stored, read twice) with ``pos``, the place of each row in its group from 0, ``n``, the rows of
    the group, and ``rank``, the place of the group among all groups from 1, nulls first.

    Rows are dealt out by ranges of group and order, so a large group spans many tasks, and stored
    with their place in their range. The ranges are counted, and a row's position is its place
    plus the rows of its group in the ranges before. Rows equal in all of ``order`` must be alike.
    """
    parts = max(1, -(-df.count() // PART_ROWS))
    by = [F.col(group).asc_nulls_first(), *order]
    ranged = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = stored(ranged.withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(F.col(group).alias("__group"), part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    counts = stored(counts, f"{name}-ranges")
    inside = Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.select("__group", "__part", "__first", F.coalesce(F.sum("__n").over(inside), F.lit(0)).alias("__before"))
    groups = counts.groupBy(F.col("__group").alias("__of")).agg(F.sum("__n").alias("n"))
    groups = groups.withColumn("rank", F.row_number().over(Window.orderBy(F.col("__of").asc_nulls_first())).cast("bigint"))
    ranges = stored(ranges.join(groups, F.col("__group").eqNullSafe(F.col("__of"))).drop("__of"), f"{name}-offsets")
    same = F.col(group).eqNullSafe(F.col("__group")) & (part == F.col("__part"))
    joined = placed.join(small(ranges), same)
    return joined.withColumn("pos", F.col("__at") - F.col("__first") + F.col("__before")).drop("__at", "__group", "__part", "__first", "__before")
