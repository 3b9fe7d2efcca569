"""Nearest-point and band lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .scan import HOT_ROWS, Running, ordered_scan


def _exact(a: T.DataType, b: T.DataType) -> str:
    """Type in which both are compared: whole numbers, also beyond 2^53, and decimals stay exact."""
    if all(isinstance(t, T.IntegralType) for t in (a, b)):
        return "bigint"
    if all(isinstance(t, (T.IntegralType, T.DecimalType)) for t in (a, b)):
        scale = max(getattr(t, "scale", 0) for t in (a, b))
        left = max(t.precision - t.scale if isinstance(t, T.DecimalType) else 19 for t in (a, b))
        if left + scale < 38:
            return f"decimal({left + scale + 1},{scale})"
    return "double"


def _neighbours(points: DataFrame, probes: DataFrame, part: list[str], x: str, probe: str,
                payload: list[str], strict: bool, idx: str, hot_rows: int | None) -> DataFrame:
    """Probes with the point before (``p``) and the point from there on (``s``).

    Points and probes are put into one order, so the work is one sort and not a join on ranges.
    With ``strict`` a point at the probe's own x counts as following.
    """
    kind = F.lit(0 if strict else 2)
    own = _exact(points.schema[x].dataType, probes.schema["at"].dataType)
    value = F.col(x).cast(own)
    a = points.where(value.isNotNull() & (~F.isnan(value) if own == "double" else F.lit(True))).select(
        *part, value.alias("__x"), F.lit(1).alias("__kind"), F.col(idx).alias("__idx"),
        F.struct(value.alias("x"), F.col(idx).alias("idx"), *payload).alias("__p"),
        F.lit(None).cast(probes.schema[probe].dataType).alias(probe),
    )
    b = probes.select(
        *part, F.col("at").cast(own).alias("__x"), kind.alias("__kind"), F.lit(None).alias("__idx"),
        F.lit(None).alias("__p"), probe,
    )
    both = a.unionByName(b)
    scanned = ordered_scan(
        both, part, ["__x", "__kind", "__idx"],
        {"p": Running("max", F.col("__p"), "before"), "s": Running("min", F.col("__p"), "after")}, hot_rows,
    )
    return scanned.where(F.col("__kind") != 1).select(*part, probe, F.col("__x").alias("at"), "p", "s")


def nearest(points: DataFrame, probes: DataFrame, part: list[str], x: str = "x", idx: str = "idx",
            payload: tuple[str, ...] = ("y",), probe: str = "probe_id", hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Nearest point of each group to every probe ``(part.., probe, at)``.

    Between two equally near points the earlier wins; past the ends the end point is taken; a
    group without points gives no row. Among points at one x, the last is taken when it precedes
    the probe and the first when it follows. Times are compared in microseconds and given back as times.
    """
    kind = points.schema[x].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
        found = nearest(points.withColumn(x, micros(x)), probes.withColumn("at", micros("at")), part, x, idx, payload, probe, hot_rows)
        return found.withColumns({c: F.timestamp_micros(F.col(c)).cast(kind) for c in ("at", "x")})
    near = _neighbours(points, probes, part, x, probe, list(payload), True, idx, hot_rows)
    later = F.col("p").isNull() | (F.abs(F.col("s.x") - F.col("at")) < F.abs(F.col("p.x") - F.col("at")))
    best = F.when(F.col("s").isNotNull() & later, F.col("s")).otherwise(F.col("p"))
    return near.withColumn("__b", best).where(F.col("__b").isNotNull()).select(*part, probe, "at", "__b.*")


def nearest_within(values: DataFrame, probes: DataFrame, part: list[str], eps: float | Column,
                   value: str = "value", idx: str = "idx", probe: str = "probe_id",
                   hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Index of the value nearest to each probe, null if none is closer than ``eps``.

    The last index wins a tie. Equal values are first reduced to their last index, so the two
    neighbours of a probe are the only candidates and no pairs are formed.
    """
    last = values.where(F.col(value).isNotNull()).groupBy(*part, value).agg(F.max(idx).alias(idx))
    near = _neighbours(last, probes, part, value, probe, [], False, idx, hot_rows)
    dp, ds = F.abs(F.col("at") - F.col("p.x")), F.abs(F.col("s.x") - F.col("at"))
    limit = eps if isinstance(eps, Column) else F.lit(eps)
    cand = F.array_sort(F.filter(
        F.array(F.struct(dp.alias("d"), (-F.col("p.idx")).alias("i")), F.struct(ds.alias("d"), (-F.col("s.idx")).alias("i"))),
        lambda c: c["d"] < limit,
    ))
    return near.select(*part, probe, "at", (-F.get(cand, F.lit(0))["i"]).alias("idx"))


def closest_index(points: DataFrame, probes: DataFrame, part: list[str], x: str = "x", idx: str = "idx",
                  probe: str = "probe_id", hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """First point in index order with the smallest distance; x need not rise with the index."""
    first = points.groupBy(*part, x).agg(F.min(idx).alias(idx))
    near = _neighbours(first, probes, part, x, probe, [], False, idx, hot_rows)
    dp, ds = F.abs(F.col("at") - F.col("p.x")), F.abs(F.col("s.x") - F.col("at"))
    cand = F.array_sort(F.filter(
        F.array(F.struct(dp.alias("d"), F.col("p.idx").alias("i")), F.struct(ds.alias("d"), F.col("s.idx").alias("i"))),
        lambda c: c["d"].isNotNull(),
    ))
    best = near.withColumn("idx", F.get(cand, F.lit(0))["i"])
    return best.where(F.col("idx").isNotNull()).select(*part, probe, "at", "idx")


def band_at(stacked: DataFrame, probes: DataFrame, probe: str = "probe_id", hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Stacked band that contains each probe ``(chart, x, at)``; null if none does.

    Bands are compared by absolute values, both ends included, and the lowest series wins.

    A band's ends are looked up by equality. For what lies between them, bands are sorted by their
    start, and the largest end so far tells where a run of overlapping bands begins. Probes and runs
    go into one order, in which each probe meets the last run that began below it. A run is one band
    in a stack; only the bands of a run that really overlap are compared with its probes one by one.
    """
    y0, dy = F.abs("y0"), F.abs("dy")
    spans = stacked.select("chart", "x", y0.cast("double").alias("lo"), (y0 + dy).cast("double").alias("hi"), "series_idx")
    spans = spans.where(F.col("lo").isNotNull() & F.col("hi").isNotNull())
    asked = materialise(probes.select(probe, "chart", "x", "at", F.abs("at").cast("double").alias("__at")), "probes")
    spans = materialise(spans.groupBy("chart", "x", "lo", "hi").agg(F.min("series_idx").alias("series_idx")), "bands")

    ends = spans.select("chart", "x", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("__at"), "series_idx")
    ends = ends.groupBy("chart", "x", "__at").agg(F.min("series_idx").alias("__end"))

    part = ["chart", "x"]
    inner = spans.where(F.col("lo") < F.col("hi"))
    carried = ordered_scan(inner, part, ["lo", "hi"], {"__top": Running("max", F.col("hi"), "before")}, hot_rows)
    begins = F.coalesce(F.col("lo") >= F.col("__top"), F.lit(True))
    numbered = materialise(carried.withColumn("__begins", begins.cast("bigint")).drop("__top"), "carried")
    runs = materialise(ordered_scan(numbered, part, ["lo", "hi"], {"run": Running("sum", F.col("__begins"))}, hot_rows).drop("__begins"), "runs")
    whole = runs.groupBy(*part, "run").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("n"), F.min("series_idx").alias("series_idx")
    )
    at_run = F.struct("lo", "hi", "n", "run", "series_idx")
    lined = whole.select(*part, F.col("lo").alias("__x"), F.lit(1).alias("__kind"), at_run.alias("__run"), F.lit(None).cast(asked.schema[probe].dataType).alias(probe), F.lit(None).cast(asked.schema["at"].dataType).alias("at"))
    put = asked.where(F.col("__at").isNotNull()).select(*part, F.col("__at").alias("__x"), F.lit(0).alias("__kind"), F.lit(None).cast(lined.schema["__run"].dataType).alias("__run"), probe, "at")
    met = ordered_scan(materialise(lined.unionByName(put), "lined"), part, ["__x", "__kind"], {"__last": Running("max", F.col("__run"), "before")}, hot_rows)
    near = met.where((F.col("__kind") == 0) & (F.col("__x") < F.col("__last.hi")))
    near = materialise(near.select(*part, probe, "at", F.col("__x").alias("__at"), F.col("__last.n").alias("n"), F.col("__last.run").alias("run"), F.col("__last.series_idx").alias("__in")), "near")
    alone = near.where(F.col("n") == 1).select(probe, *part, "at", F.col("__in").alias("series_idx"))
    shared = near.where(F.col("n") > 1).drop("__in").join(runs, [*part, "run"]).where((F.col("lo") < F.col("__at")) & (F.col("__at") < F.col("hi")))
    touched = asked.join(ends, [*part, "__at"]).select(probe, *part, "at", F.col("__end").alias("series_idx"))
    nothing = asked.select(probe, *part, "at", F.lit(None).cast(spans.schema["series_idx"].dataType).alias("series_idx"))
    found = nothing.unionByName(alone).unionByName(shared.select(probe, *part, "at", "series_idx")).unionByName(touched)
    return found.groupBy(probe, *part, "at").agg(F.min("series_idx").alias("series_idx"))


def cross_section(points: DataFrame, probes: DataFrame, expand: bool = False, probe: str = "probe_id",
                  hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Value of every series of a chart at each probe ``(chart, probe, at)``, and their total.

    The total row is left out in share mode, below two series, and when every value is null.
    """
    keys = points.select("chart", "key").distinct()
    spread = probes.join(keys, "chart")
    rows = nearest(points, spread, ["chart", "key"], probe=probe, hot_rows=hot_rows)
    if expand:
        return rows.select("chart", probe, "key", F.col("y").alias("value"), F.lit(False).alias("total"))
    rolled = rows.groupingSets([["chart", probe, "key"], ["chart", probe]], "chart", probe, "key").agg(
        F.sum("y").alias("value"), F.count("y").alias("__known"), F.count(F.lit(1)).alias("__n"),
        F.grouping_id().alias("__g"),
    )
    total = (F.col("__g") == 1) & (F.col("__known") > 0) & (F.col("__n") >= 2)
    kept = rolled.where((F.col("__g") == 0) | total)
    name = F.when(F.col("__g") == 1, F.lit("TOTAL")).otherwise(F.col("key"))
    return kept.select("chart", probe, name.alias("key"), "value", (F.col("__g") == 1).alias("total"))
