"""Operators on series in long form: ``chart, key, series_idx, x, y`` and optionally ``enabled``.

Groups that grow with the data (all points of a series, all series at one x, all x of a chart) go
through :mod:`.scan`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import safe_divide
from ..session import materialise
from .scan import HOT_ROWS, Running, ordered_scan, row_number

SERIES = ["chart", "key"]


def point_index(series: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Position of each point in its series (``idx``), from 0."""
    return row_number(series, SERIES, ["x"], "idx", hot_rows, start=0)


def series_index(series: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Position of each series in its chart by name, as a table of series."""
    names = series.select(*SERIES).distinct()
    return row_number(names, ["chart"], ["key"], "series_idx", hot_rows, start=0)


def brush(series: DataFrame, lo, hi, x: str = "x") -> DataFrame:
    """Points inside the closed range."""
    return series.where((F.col(x) >= lo) & (F.col(x) <= hi))


def select_series(series: DataFrame, off: list[str]) -> DataFrame:
    """Drop the series named in ``off``; a chart with all of its series off gets all back."""
    hidden = F.col("key").isin(off)
    charts = series.groupBy("chart").agg(F.min(hidden.cast("int")).alias("__all_off"))
    shown = series.join(charts, "chart").where(~hidden | (F.col("__all_off") == 1))
    return shown.drop("__all_off")


def solo(series: DataFrame, key: str, toggle: bool = False) -> DataFrame:
    """Enable only ``key``. With ``toggle``, a chart that shows a single series shows all again."""
    only = F.col("key") == key
    if not toggle:
        return series.withColumn("enabled", only)
    lit_keys = F.when(F.col("enabled"), F.col("key"))
    shown = series.groupBy("chart").agg(F.min(lit_keys).alias("__a"), F.max(lit_keys).alias("__z"))
    single = F.coalesce(F.col("__a") == F.col("__z"), F.lit(False))
    return series.join(shown, "chart").withColumn("enabled", single | only).drop("__a", "__z")


def split_series(series: DataFrame, kind: str, axis: int) -> DataFrame:
    """Series of one type on one axis."""
    return series.where((F.col("type") == kind) & (F.col("axis") == axis))


def segments(series: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Defined points with the number of the unbroken piece they belong to."""
    gap = F.col("y").isNull() | F.isnan("y")
    numbered = ordered_scan(series, SERIES, ["x"], {"segment": Running("sum", gap.cast("bigint"))}, hot_rows)
    return numbered.where(~gap)


def stride(series: DataFrame, m: int, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Every k-th point, ``k = ceil(points / m)``."""
    indexed = point_index(series, hot_rows)
    counts = series.groupBy(*SERIES).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(m))).alias("__k"))
    return indexed.join(counts, SERIES).where(F.col("idx") % F.col("__k") == 0).drop("__k")


def avg_lines(series: DataFrame) -> DataFrame:
    """Series with a mean that is neither missing nor 0."""
    means = series.groupBy(*SERIES).agg(F.avg("y").alias("average"))
    return means.where(F.col("average").isNotNull() & (F.col("average") != 0))


def tail(series: DataFrame, n: int, part: list[str] = SERIES, order: list[str] | None = None) -> DataFrame:
    """Last ``n`` points of each series. The rank limit is applied on both sides of the shuffle."""
    by = [F.col(o).desc() for o in (order or ["x"])]
    ranked = series.withColumn("__rn", F.row_number().over(Window.partitionBy(*part).orderBy(*by)))
    return ranked.where(F.col("__rn") <= n).drop("__rn")


def merge_points(*series: DataFrame) -> DataFrame:
    """All points of several tables, duplicates kept."""
    merged = series[0]
    for s in series[1:]:
        merged = merged.unionByName(s, allowMissingColumns=True)
    return merged


def _enabled(series: DataFrame) -> DataFrame:
    return series.where(F.col("enabled")) if "enabled" in series.columns else series


def _lighter_side(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk the series chart by chart, in order, with two sums and two counts as the only state."""
    chart, sums, counts = None, [0.0, 0.0], [0, 0]
    started = False
    for rows in frames:
        sides, places = [], []
        for name, weight in zip(rows["chart"], rows["weight"], strict=True):
            if not started or name != chart and not (pd.isna(name) and pd.isna(chart)):
                started, chart, sums, counts = True, name, [0.0, 0.0], [0, 0]
            side = int(sums[1] < sums[0])  # 1 is above; of equal sums the one below takes it
            sides.append(side)
            places.append(counts[side])
            sums[side] += weight
            counts[side] += 1
        yield rows[["chart", "key", "series_idx"]].assign(side=sides, place=places)


def series_order(series: DataFrame) -> DataFrame:
    """Inside-out order ``(chart, key, series_idx, pos)``: series by the x of their peak, each put on the lighter side.

    The greedy step walks one record per series, sorted, and keeps two sums and two counts of the
    present chart; a series' position follows from its place on its side and the number below.
    """
    y = F.coalesce("y", F.lit(0.0))
    rows = _enabled(series)
    tallest = rows.groupBy(*SERIES).agg(F.max(y).alias("__y"), F.sum(y).alias("weight"), F.min("series_idx").alias("series_idx"))
    keyed = tallest.select(F.col("chart").alias("__c"), F.col("key").alias("__k"), "__y", "weight", F.col("series_idx").alias("__i"))
    same = F.col("chart").eqNullSafe(F.col("__c")) & F.col("key").eqNullSafe(F.col("__k")) & (y == F.col("__y"))
    peaks = rows.join(keyed, same).groupBy(*SERIES).agg(F.min("x").alias("peak"), F.max("weight").alias("weight"), F.min("__i").cast("bigint").alias("series_idx"))
    sorted_ = peaks.repartition("chart").sortWithinPartitions("chart", "peak", "series_idx", "key")
    kind = series.schema
    shape = T.StructType([
        T.StructField("chart", kind["chart"].dataType), T.StructField("key", kind["key"].dataType), T.StructField("series_idx", T.LongType()),
        T.StructField("side", T.IntegerType()), T.StructField("place", T.LongType()),
    ])
    placed = sorted_.select("chart", "key", "series_idx", "weight").mapInPandas(_lighter_side, shape)
    below = placed.groupBy(F.col("chart").alias("__c")).agg(F.sum(1 - F.col("side")).alias("__below"))
    at = F.when(F.col("side") == 0, F.col("__below") - 1 - F.col("place")).otherwise(F.col("__below") + F.col("place"))
    whole = placed.join(below, F.col("chart").eqNullSafe(F.col("__c")))
    return whole.select("chart", "key", F.col("series_idx").cast(kind["series_idx"].dataType).alias("series_idx"), at.cast("int").alias("pos"))


def _positions(series: DataFrame, order: str) -> DataFrame:
    rows = _enabled(series).withColumn("y", F.coalesce("y", F.lit(0.0)))
    if order == "default":
        return rows.withColumn("pos", F.col("series_idx"))
    found = series_order(series).select(F.col("chart").alias("__c"), F.col("key").alias("__k"), "pos")
    return rows.join(found, F.col("chart").eqNullSafe(F.col("__c")) & F.col("key").eqNullSafe(F.col("__k"))).drop("__c", "__k")


AT_X = ["chart", "x"]


def _below(rows: DataFrame, column: Column, name: str, hot_rows: int | None, by: str = "pos") -> DataFrame:
    """Add the sum of the series below each one at its x. A large ``(chart, x)`` is cut into blocks."""
    scanned = ordered_scan(rows, AT_X, [by], {name: Running("sum", column, "before")}, hot_rows)
    return scanned.withColumn(name, F.coalesce(F.col(name), F.lit(0.0)))


def _with_total(rows: DataFrame, total: DataFrame) -> DataFrame:
    """Add values per ``(chart, x)``, summed before the shuffle."""
    keyed = total.withColumnsRenamed({"chart": "__c", "x": "__x"})
    return rows.join(keyed, F.col("chart").eqNullSafe(F.col("__c")) & F.col("x").eqNullSafe(F.col("__x"))).drop("__c", "__x")


def stack(series: DataFrame, offset: str = "zero", order: str = "default",
          hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Stack the enabled series of each chart; adds ``y0`` (bottom) and ``dy`` (height).

    ``offset`` is zero, expand, percent, silhouette or wiggle; ``order`` default or inside-out.
    """
    if offset not in ("zero", "expand", "percent", "silhouette", "wiggle"):
        raise ValueError(f"unknown offset {offset!r}")
    if offset == "percent":
        # hidden series count in the total, so it is taken before they are left out
        sums = series.groupBy(*AT_X).agg(F.sum(F.coalesce("y", F.lit(0.0))).alias("__total"))
        rows = _with_total(_positions(series, order), sums)
        rows = rows.withColumn("dy", F.coalesce(safe_divide(F.col("y"), F.col("__total")), F.lit(0.0))).drop("__total")
    else:
        rows = _positions(series, order)
    if offset in ("expand", "silhouette"):
        sums = rows.groupBy(*AT_X).agg(F.sum("y").alias("__total"), F.count(F.lit(1)).alias("__n"))
        rows = _with_total(rows, sums)
    if offset == "expand":
        share = F.when(F.col("__total") != 0, F.col("y") / F.col("__total")).otherwise(F.lit(1.0) / F.col("__n"))
        rows = rows.withColumn("dy", share).drop("__total", "__n")
    elif offset != "percent":
        rows = rows.withColumn("dy", F.col("y"))
    out = _below(rows, F.col("dy"), "y0", hot_rows)
    if offset == "silhouette":
        tallest = sums.groupBy(F.col("chart").alias("__c")).agg(F.max("__total").alias("__max"))
        shift = (F.col("__max") - F.col("__total")) / 2
        out = out.join(tallest, F.col("chart").eqNullSafe(F.col("__c"))).withColumn("y0", F.col("y0") + shift).drop("__total", "__max", "__n", "__c")
    elif offset == "wiggle":
        base = wiggle_baseline(rows, hot_rows)
        out = out.join(base, AT_X).withColumn("y0", F.col("y0") + F.col("base")).drop("base")
    return out.drop("pos") if order == "default" else out


def wiggle_baseline(rows: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Baseline per x that keeps the weighted change of slopes least (Byron and Wattenberg)."""
    point = F.struct("x", "y")
    prev = ordered_scan(rows.drop("dy"), ["chart", "key"], ["x"], {"__prev": Running("max", point, "before")}, hot_rows)
    dx = F.col("x") - F.col("__prev.x")
    slope = F.coalesce((F.col("y") - F.col("__prev.y")) / dx, F.lit(0.0))
    moved = prev.withColumns({"__dx": dx, "__slope": slope})
    moved = _below(moved, F.col("__slope"), "__sum", hot_rows).withColumn("__mid", F.col("__sum") + F.col("__slope") / 2)
    per_x = moved.groupBy("chart", "x").agg(
        F.sum("y").alias("s1"), F.sum(F.col("__mid") * F.col("y")).alias("s2"), F.max("__dx").alias("dx")
    )
    step = F.coalesce(F.when(F.col("s1") != 0, F.col("s2") / F.col("s1") * F.col("dx")), F.lit(0.0))
    # stored, as the scan reads its input several times and this one rests on a scan itself
    steps = materialise(per_x.select("chart", "x", (-step).alias("step")), "steps")
    walked = ordered_scan(steps, ["chart"], ["x"], {"o": Running("sum", F.col("step"))}, hot_rows)
    lowest = walked.groupBy("chart").agg(F.least(F.min("o"), F.lit(0.0)).alias("l"))
    return walked.join(lowest, "chart").select("chart", "x", (F.col("o") - F.col("l")).alias("base"))


def signed_stack(series: DataFrame, non_stackable: list[str] = (), hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Bars stacked upwards from 0 for values >= 0 and downwards for negative ones.

    Series in ``non_stackable`` stand on 0 by themselves.
    """
    free = F.col("key").isin(list(non_stackable)) if non_stackable else F.lit(False)
    y = F.coalesce("y", F.lit(0.0))
    sums = {"__up": Running("sum", F.when(~free & (y >= 0), y), "before"), "__down": Running("sum", F.when(~free & (y < 0), y), "before")}
    rows = ordered_scan(series, AT_X, ["series_idx"], sums, hot_rows)
    base = F.when(free, F.lit(0.0)).when(y < 0, F.coalesce("__down", F.lit(0.0))).otherwise(F.coalesce("__up", F.lit(0.0)))
    rows = rows.withColumn("__base", base)
    return rows.withColumns({
        "bar_lo": F.least(F.col("__base"), F.col("__base") + y),
        "bar_hi": F.greatest(F.col("__base"), F.col("__base") + y),
    }).drop("__base", "__up", "__down")


def rebase(indexed: DataFrame, i: int, guard: bool = True) -> DataFrame:
    """Change of each point against the value ``v`` at position ``i``: ``(y - v) / (1 + v)``.

    A series without that position keeps its values; one with ``v < -0.95`` does too and is
    flagged in ``off`` (unless ``guard`` is False).
    """
    at = indexed.groupBy(*SERIES).agg(F.max(F.when(F.col("idx") == i, F.col("y"))).alias("__v"))
    rows = indexed.join(at, SERIES)
    lost = F.coalesce(F.col("__v") < -0.95, F.lit(False)) if guard else F.lit(False)
    moved = safe_divide(F.col("y") - F.col("__v"), 1 + F.col("__v"))
    shown = F.when(lost | F.col("__v").isNull(), F.col("y")).otherwise(moved)
    return rows.withColumns({"display": shown, "off": lost}).drop("__v")


def rebase_extent(series: DataFrame) -> DataFrame:
    """Range of rebased values, per series and over each chart (``key`` null)."""
    ends = _enabled(series).groupBy(*SERIES).agg(F.greatest(F.min("y"), F.lit(-0.95)).alias("a"), F.max("y").alias("b"))
    per = ends.select(
        *SERIES,
        safe_divide(F.col("a") - F.col("b"), 1 + F.col("b")).alias("lo"),
        safe_divide(F.col("b") - F.col("a"), 1 + F.col("a")).alias("hi"),
    )
    sets = per.groupingSets([["chart", "key"], ["chart"]], "chart", "key")
    return sets.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def spark_points(indexed: DataFrame) -> DataFrame:
    """First minimum, last maximum and last point of each series.

    The values come first, by sums of fixed width; the few points that have them then settle the positions.
    """
    ends = indexed.groupBy(*SERIES).agg(F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.max("idx").alias("__last"))
    keyed = ends.withColumnsRenamed({"chart": "__c", "key": "__k"})
    y, idx = F.col("y"), F.col("idx")
    at = (y == F.col("min_y")) | (y == F.col("max_y")) | (idx == F.col("__last"))
    met = indexed.join(keyed, F.col("chart").eqNullSafe(F.col("__c")) & F.col("key").eqNullSafe(F.col("__k")) & at)
    # a point of a series is known by its index, so the last two values are the same for all rows that count
    found = met.groupBy(*SERIES, "min_y", "max_y").agg(
        F.min_by("x", F.when(y == F.col("min_y"), idx)).alias("min_x"), F.max_by("x", F.when(y == F.col("max_y"), idx)).alias("max_x"),
        F.max(F.when(idx == F.col("__last"), F.col("x"))).alias("last_x"), F.max(F.when(idx == F.col("__last"), y)).alias("last_y"),
    )
    return found.select(*SERIES, "min_x", "min_y", "max_x", "max_y", "last_x", "last_y")


def area_total(series: DataFrame) -> DataFrame:
    """Sum of all series per axis and x, together with the point (0, 0)."""
    sums = series.groupBy("axis", "x").agg(F.sum("y").alias("y"))
    zero = series.select("axis").distinct().select("axis", F.lit(0).cast(series.schema["x"].dataType).alias("x"), F.lit(0.0).alias("y"))
    return sums.unionByName(zero)


def max_len(series: DataFrame) -> DataFrame:
    """Largest number of points in any series of a chart."""
    return series.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n")).groupBy("chart").agg(F.max("n").alias("max_len"))


def widened(lo: Column, hi: Column) -> tuple[Column, Column]:
    """A one-point range gets 1 % on both sides, or becomes [-1, 1] at zero."""
    point = lo == hi
    return (
        F.when(point & (lo != 0), lo - lo * 0.01).when(point, F.lit(-1.0)).otherwise(lo),
        F.when(point & (hi != 0), hi + hi * 0.01).when(point, F.lit(1.0)).otherwise(hi),
    )


def extent(series: DataFrame, part: list[str], cols: list[str], force: dict[str, list[float]] | None = None,
           log: str | None = None) -> DataFrame:
    """Smallest and largest value per column, forced values included.

    The column named in ``log`` counts a 0 as a tenth of its smallest non-zero value.
    """
    aggs = []
    for c in cols:
        v = F.col(c).cast("double")
        aggs += [F.min(v).alias(f"{c}_lo"), F.max(v).alias(f"{c}_hi")]
        if c == log:
            aggs += [F.min(F.when(v != 0, v)).alias("__nz_lo"), F.max(F.when(v != 0, v)).alias("__nz_hi"),
                     F.max((v == 0).cast("int")).alias("__zero")]
    out = series.groupBy(*part).agg(*aggs)
    shown = []
    for c in cols:
        lo, hi = F.col(f"{c}_lo"), F.col(f"{c}_hi")
        if c == log:
            tenth = F.when(F.col("__zero") == 1, F.col("__nz_lo") * 0.1)
            lo, hi = F.least(F.col("__nz_lo"), tenth), F.greatest(F.col("__nz_hi"), tenth)
        forced = [F.lit(float(v)) for v in (force or {}).get(c, [])]
        if forced:
            lo, hi = F.least(lo, *forced), F.greatest(hi, *forced)
        lo, hi = widened(lo, hi)
        shown += [lo.alias(f"{c}_lo"), hi.alias(f"{c}_hi")]
    return out.select(*part, *shown)
