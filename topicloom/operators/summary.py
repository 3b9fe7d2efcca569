"""Box, price-bar and regression summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .scan import HOT_ROWS, Running, ordered_scan

QUARTILES = (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))


def _counted(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Distinct values with their copies: equal values are merged before the shuffle."""
    v = F.col(value).cast("double")
    return df.where(v.isNotNull()).groupBy(*group, v.alias("v")).agg(F.count(F.lit(1)).alias("copies"))


def quartiles(df: DataFrame, group: list[str], value: str, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Exact quartiles with linear interpolation, from the ranks of the distinct values.

    The rank scan splits a hot group, so no task holds all values of a group, as the built-in
    exact percentile would. :mod:`.sketches` has the approximate form.
    """
    return _quartiles(materialise(_counted(df, group, value), "counted"), group, hot_rows)


def _quartiles(counted: DataFrame, group: list[str], hot_rows: int | None) -> DataFrame:
    ranked = ordered_scan(counted, group, ["v"], {"upto": Running("sum", F.col("copies"))}, hot_rows)
    sizes = counted.groupBy(*group).agg(F.sum("copies").alias("n"))
    rows = ranked.join(sizes, group)

    def at(rank: Column) -> Column:
        inside = (F.col("upto") - F.col("copies") <= rank) & (rank < F.col("upto"))
        return F.max(F.when(inside, F.col("v")))

    aggs = [F.max("n").alias("n")]
    for name, p in QUARTILES:
        r = (F.col("n") - 1) * F.lit(p)
        aggs += [at(F.floor(r)).alias(f"{name}_a"), at(F.ceil(r)).alias(f"{name}_b")]
    ends = rows.groupBy(*group).agg(*aggs)
    out = []
    for name, p in QUARTILES:
        r = (F.col("n") - 1) * F.lit(p)
        out.append((F.col(f"{name}_a") + (F.col(f"{name}_b") - F.col(f"{name}_a")) * (r - F.floor(r))).alias(name))
    return ends.select(*group, "n", *out)


def _fenced(df: DataFrame, group: list[str], value: str, hot_rows: int | None) -> DataFrame:
    counted = materialise(_counted(df, group, value), "counted")
    box = _quartiles(counted, group, hot_rows)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    rows = counted.join(box, group)
    return rows.withColumn("inside", F.col("v").between(F.col("q1") - reach, F.col("q3") + reach))


def box_summary(df: DataFrame, group: list[str], value: str, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5 times the quartile distance, outliers counted.

    The outliers themselves, of any number, are rows of :func:`box_outliers`.
    """
    inside = F.col("inside")
    return _fenced(df, group, value, hot_rows).groupBy(*group).agg(
        *[F.max(n).alias(n) for n, _ in QUARTILES],
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.sum(F.when(~inside, F.col("copies")).otherwise(0)).alias("n_outliers"),
    )


def box_outliers(df: DataFrame, group: list[str], value: str, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Values outside the whiskers, one row per distinct value with its copies."""
    rows = _fenced(df, group, value, hot_rows).where(~F.col("inside"))
    return rows.select(*group, F.col("v").alias("outlier"), "copies")


def box_extent(boxes: DataFrame, outliers: DataFrame, part: list[str]) -> DataFrame:
    """Smallest and largest of whiskers, quartiles and outliers; zeros count."""
    parts = F.array("whisker_low", "q1", "q3", "whisker_high")
    flat = boxes.select(*part, F.explode(parts).alias("v"))
    both = flat.unionByName(outliers.select(*part, F.col("outlier").alias("v")))
    return both.groupBy(*part).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def box_extent_nested(boxes: DataFrame, part: list[str], outliers: str = "outliers") -> DataFrame:
    """The same for boxes that carry their outliers in an array."""
    parts = F.concat(F.array("whisker_low", "q1", "q3", "whisker_high"), F.coalesce(outliers, F.array().cast("array<double>")))
    return boxes.select(*part, F.explode(parts).alias("v")).groupBy(*part).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def first_last(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """``(group.., first, last)``: the value of the first and of the last row of each group along ``order``.

    The ends of the first order column are found by an aggregation of fixed width. The rows at these
    ends, mostly one or two, are stored and settle the next column, and so on. An order column is not null; rows
    equal in all of them are alike.
    """
    rows = df.select(*group, *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)], F.col(value).alias("__v"))
    rows = rows.withColumns({"__first": F.lit(True), "__last": F.lit(True)})
    for i in range(len(order)):
        o = F.col(f"__o{i}")
        ends = rows.groupBy(*[F.col(g).alias(f"__g{j}") for j, g in enumerate(group)]).agg(
            F.min(F.when(F.col("__first"), o)).alias("__lo"), F.max(F.when(F.col("__last"), o)).alias("__hi")
        )
        same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__g{j}")) for j, g in enumerate(group)])
        first, last = F.col("__first") & (o == F.col("__lo")), F.col("__last") & (o == F.col("__hi"))
        met = rows.join(ends, same).withColumns({"__first": first, "__last": last}).where(F.col("__first") | F.col("__last"))
        rows = met.drop("__lo", "__hi", f"__o{i}", *[f"__g{j}" for j in range(len(group))])
        if i == 0 and len(order) > 1:
            rows = materialise(rows, "ends")  # few, and read twice by each of the next steps
    return rows.groupBy(*group).agg(
        F.max(F.when(F.col("__first"), F.col("__v"))).alias("first"), F.max(F.when(F.col("__last"), F.col("__v"))).alias("last")
    )


def ohlc(df: DataFrame, part: list[str], bucket: Column, order: list[str], value: str) -> DataFrame:
    """Open, high, low and close per bucket; ``order`` must be unique within a bucket."""
    rows = df.select(*part, bucket.alias("bucket"), *dict.fromkeys([*order, value]))
    group = [*part, "bucket"]
    range_ = rows.groupBy(*group).agg(F.max(value).alias("high"), F.min(value).alias("low"))
    ends = first_last(rows, group, order, value)
    ends = ends.select(*[F.col(g).alias(f"__g{j}") for j, g in enumerate(group)], F.col("first").alias("open"), F.col("last").alias("close"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__g{j}")) for j, g in enumerate(group)])
    return range_.join(ends, same).select(*group, "open", "high", "low", "close")


def ohlc_extent(bars: DataFrame, part: list[str]) -> DataFrame:
    """Range of bars: lowest low to highest high."""
    return bars.groupBy(*part).agg(F.min("low").alias("lo"), F.max("high").alias("hi"))


def reg_line(series: DataFrame) -> DataFrame:
    """Least-squares line per series with its heights at both ends of the chart's x range."""
    lines = series.groupBy("chart", "key").agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept")
    )
    ends = series.groupBy("chart").agg(F.min("x").cast("double").alias("x_lo"), F.max("x").cast("double").alias("x_hi"))

    def height(x: str) -> Column:
        return F.col(x) * F.col("slope") + F.col("intercept")

    return lines.join(ends, "chart").select(
        "chart", "key", "slope", "intercept", height("x_lo").alias("y_lo"), height("x_hi").alias("y_hi")
    )
