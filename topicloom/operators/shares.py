"""Shares of a total and the cut at a share of mass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import HOT_ROWS, Running, ordered_scan

DIGITS = 12


def totals(df: DataFrame, part: list[str], weight: str) -> DataFrame:
    """Sum and smallest weight per group; summed before the shuffle, so a hot group is no burden."""
    return df.groupBy(*part).agg(F.sum(weight).alias("total"), F.min(weight).alias("least"))


def share(df: DataFrame, part: list[str], weight: str, name: str = "share") -> DataFrame:
    """Weight over the sum of its group. A group that sums to 0 has null shares.

    Aggregate and join rather than a window: a window would gather each group in one task.
    """
    sums = totals(df, part, weight)
    ratio = F.when(F.col("total") != 0, F.col(weight) / F.col("total"))
    return df.join(sums, part).withColumn(name, ratio).drop("total", "least")


def row_shares(weights: Column) -> Column:
    """Entries of an array divided by their sum; null when the sum is 0."""
    total = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)
    return F.when(total != 0, F.transform(weights, lambda w: w / total))


def mass_cut(df: DataFrame, part: list[str], ident: str, weight: str, p: float,
             hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Heaviest items of each group whose inclusive running share stays strictly below ``p``.

    Order: share descending, then ``ident`` descending; items without a weight are left out. Adds ``share``, ``cum`` and ``rank``.
    With no negative weight, a block of a hot group whose carried share has reached ``p`` cannot
    hold a survivor, so the long tail of light items is dropped before the shuffle.
    """
    sums = totals(df, part, weight)
    ratio = F.when(F.col("total") != 0, F.col(weight) / F.col("total"))
    shared = df.where(F.col(weight).isNotNull()).join(sums, part).withColumn("share", ratio)
    scanned = ordered_scan(
        shared,
        part,
        [-F.col("share"), -F.col(ident)],
        {"cum": Running("sum", F.col("share")), "rank": Running("sum", F.lit(1).cast("bigint"))},
        hot_rows,
        keep=lambda carried: F.coalesce(F.round(carried["cum"], DIGITS) < p, F.lit(True)) | (F.col("least") < 0),
    )
    return scanned.where(F.round("cum", DIGITS) < p).drop("total", "least")


def rank_by_weight(df: DataFrame, part: list[str], ident: str, weight: str,
                   hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Position by weight descending with the higher ``ident`` first among equals; null weights come last."""
    one = F.lit(1).cast("bigint")
    return ordered_scan(df, part, [F.col(weight).isNull(), -F.col(weight), -F.col(ident)], {"rank": Running("sum", one)}, hot_rows)


def weight_check(df: DataFrame, ident: str, weights: str, eps: float = 1e-9) -> DataFrame:
    """Rows whose weights do not add to 1 within ``eps``."""
    total = F.aggregate(F.col(weights), F.lit(0.0), lambda acc, w: acc + w)
    return df.select(ident, total.alias("total")).where(
        F.col("total").isNull() | (F.abs(F.col("total") - 1.0) > eps)
    )


def slice_share(df: DataFrame, part: list[str], value: str, disabled: str) -> DataFrame:
    """Share of each slice with hidden slices counted as 0."""
    shown = df.withColumn("__shown", F.when(F.col(disabled), F.lit(0.0)).otherwise(F.col(value)))
    return share(shown, part, "__shown").drop("__shown")


def slice_bounds(df: DataFrame, part: list[str], order: list[str], value: str, disabled: str,
                 hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Where each slice starts and ends, as shares of the whole (``start``, ``end``), in the given order.

    A hidden slice has no width. A group that sums to 0 has null bounds.
    """
    shown = slice_share(df, part, value, disabled)
    scanned = ordered_scan(shown, part, order, {"start": Running("sum", F.col("share"), "before")}, hot_rows)
    start = F.when(F.col("share").isNotNull(), F.coalesce("start", F.lit(0.0)))
    return scanned.withColumn("start", start).withColumn("end", F.col("start") + F.col("share"))
