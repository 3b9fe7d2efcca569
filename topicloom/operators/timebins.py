"""Topic weight and document counts over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bin_left, bin_right_closed, bin_right_closed_edge, comparable_time, epoch_seconds_of, timestamp_literal


def between_open(df: DataFrame, ts: str, lo: int, hi: int) -> DataFrame:
    """Rows whose time in whole seconds lies strictly between ``lo`` and ``hi``.

    Written on the stored column with literals of its own type, so the file scan can skip data.
    ISO text is parsed first; text that does not parse is outside.
    """
    t = comparable_time(df, ts)
    return df.where((t >= timestamp_literal(df, ts, lo + 1)) & (t < timestamp_literal(df, ts, hi)))


def binned(df: DataFrame, ts: str, lo: int, hi: int, n: int) -> DataFrame:
    """Rows inside the open range with their left border in ``bin``."""
    inside = between_open(df, ts, lo, hi)
    return inside.withColumn("bin", bin_left(epoch_seconds_of(inside, ts), lo, hi, n))


def weight_columns(weights: str, k: int) -> list[tuple[str, Column]]:
    return [(f"topic_{i}", F.get(F.col(weights), F.lit(i))) for i in range(k)]


def topic_series(df: DataFrame, ts: str, weights: str, k: int, lo: int, hi: int, n: int,
                 agg=F.sum, fill_empty: bool = False) -> DataFrame:
    """One row per bin with the sum (or another aggregate) of every topic's weight."""
    rows = binned(df, ts, lo, hi, n)
    out = rows.groupBy("bin").agg(*[agg(c).alias(name) for name, c in weight_columns(weights, k)])
    if not fill_empty:
        return out
    all_bins = df.sparkSession.range(n).select(_border(F.col("id"), lo, hi, n).alias("bin"))
    filled = all_bins.join(out, "bin", "left")
    return filled.na.fill(0.0, [name for name, _ in weight_columns(weights, k)])


def _border(k: Column, lo: int, hi: int, n: int) -> Column:
    from ..functions import border

    return border(k, lo, hi, n)


def doc_counts(df: DataFrame, ts: str, lo: int, hi: int, n: int) -> DataFrame:
    """Documents per non-empty bin."""
    return binned(df, ts, lo, hi, n).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))


def time_extent(df: DataFrame, ts: str) -> DataFrame:
    """First and last second in one pass."""
    seconds = epoch_seconds_of(df, ts)
    return df.agg(F.min(seconds).alias("min_ts"), F.max(seconds).alias("max_ts"))


def span(df: DataFrame, ts: str) -> DataFrame:
    """Length of the covered time in years of 365 days and in twelfths of them."""
    years = (F.col("max_ts") - F.col("min_ts")) / F.lit(365.0 * 24 * 3600)
    return time_extent(df, ts).select(years.alias("years"), (years * 12).alias("months"))


def out_of_range(df: DataFrame, ts: str, lo: int, hi: int) -> DataFrame:
    """How many rows the open range drops: no time, too early, too late."""
    t = epoch_seconds_of(df, ts)
    return df.agg(
        F.count_if(t.isNull()).alias("no_time"),
        F.count_if(t <= lo).alias("early"),
        F.count_if(t >= hi).alias("late"),
    )


def cut_sum(df: DataFrame, x: Column, values: list[tuple[str, Column]], n: int, times: DataFrame | None = None) -> DataFrame:
    """Sums per right-closed equal-width bin over the whole range of ``x``; every bin is kept.

    The range is a scalar subquery, so the engine runs it once and inlines two numbers. ``times``, rows
    with the same times as ``df`` but without its weights, saves computing ``df`` for the range.
    """
    extent = (df if times is None else times).select(x.cast("double").alias("x")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    ends = extent.select(F.struct("lo", "hi")).scalar()
    rows = df.select(x.cast("double").alias("x"), *[c.alias(name) for name, c in values])
    rows = rows.withColumn("bin", bin_right_closed(F.col("x"), ends["lo"], ends["hi"], n))
    sums = rows.groupBy("bin").agg(*[F.sum(name).alias(name) for name, _ in values])
    all_bins = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    filled = all_bins.join(sums, "bin", "left")
    return filled.select(
        "bin",
        bin_right_closed_edge(F.col("bin"), ends["lo"], ends["hi"], n).alias("bin_lo"),
        *[F.coalesce(name, F.lit(0.0)).alias(name) for name, _ in values],
    )
