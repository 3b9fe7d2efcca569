"""Mergeable sketches per group and time bin: quantiles and distinct counts over any range of bins.

A sketch has a bounded size, whatever the number of rows, and merging sketches gives the sketch of all
their rows. So a table of one sketch per group and bin answers for every union of bins without the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size parameter of the quantile sketch, and a bound of its rank error (share of the rows, 99 % sure) for
#: one sketch and for merged ones alike: about ``2.3 / K ** 0.9``, as published for this sketch.
K = 200
RANK_ERROR = 2.3 / K ** 0.9
#: Logarithm of the number of registers of the distinct sketch, and three times its standard error.
LG_K = 12
COUNT_ERROR = 3 * 1.04 / 2 ** (LG_K / 2)


def quantile_sketches(df: DataFrame, group: list[str], bin_: Column, value: str, k: int = K) -> DataFrame:
    """``(group.., bin, n, sketch)``: a quantile sketch of the values of each group and bin; nulls do not count."""
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*group, bin_.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch")
    )


def sketched_quantiles(sketches: DataFrame, group: list[str], probabilities: list[float], lo=None, hi=None) -> DataFrame:
    """``(group.., n, probability, value)`` over the bins from ``lo`` to ``hi``, both included.

    A value's rank is off by at most :data:`RANK_ERROR` of the rows. The exact form is
    :func:`topicloom.operators.summary.quartiles`.
    """
    merged = _bins(sketches, lo, hi).groupBy(*group).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    each = [F.struct(F.lit(float(p)).alias("probability"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("value")) for p in probabilities]
    return merged.select(*group, "n", F.inline(F.array(*each)))


def distinct_sketches(df: DataFrame, group: list[str], bin_: Column, value: str, lg_k: int = LG_K) -> DataFrame:
    """``(group.., bin, sketch)``: a sketch of the distinct values of each group and bin; nulls do not count."""
    return df.where(F.col(value).isNotNull()).groupBy(*group, bin_.alias("bin")).agg(F.hll_sketch_agg(value, F.lit(lg_k)).alias("sketch"))


def sketched_distinct(sketches: DataFrame, group: list[str], lo=None, hi=None) -> DataFrame:
    """``(group.., distinct_count)`` over the bins from ``lo`` to ``hi``, both included, within :data:`COUNT_ERROR`."""
    chosen = _bins(sketches, lo, hi)
    united = F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_count")
    return chosen.groupBy(*group).agg(united) if group else chosen.agg(united)


def _bins(sketches: DataFrame, lo, hi) -> DataFrame:
    if lo is not None:
        sketches = sketches.where(F.col("bin") >= lo)
    return sketches if hi is None else sketches.where(F.col("bin") <= hi)
