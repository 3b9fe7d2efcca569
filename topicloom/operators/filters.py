"""Predicates over documents, mail addresses and wide records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import to_number


def project(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Keep and rename columns: new name from old name."""
    return df.select(*[F.col(old).alias(new) for new, old in names.items()])


def numbered_columns(prefix: str, k: int) -> list[str]:
    """``C1..Ck``."""
    return [f"{prefix}{i + 1}" for i in range(k)]


def replace_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, value)


def starts_with(df: DataFrame, col: str, prefix: str) -> DataFrame:
    return df.where(F.col(col).startswith(prefix))


def any_starts_with(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """Rows whose array column has an element with the prefix."""
    return df.where(F.exists(col, lambda v: F.startswith(v, F.lit(prefix))))


def contains(df: DataFrame, col: str, text: str, negate: bool = False) -> DataFrame:
    hit = F.col(col).contains(text)
    return df.where(~hit if negate else hit)


def array_facts(df: DataFrame, ident: str, col: str, member: str) -> DataFrame:
    """First element, size and membership of an array column."""
    return df.select(
        ident, F.get(F.col(col), F.lit(0)).alias("first"), F.size(col).alias("size"),
        F.array_contains(col, member).alias("has_member"),
    )


def keep_keys(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """Rows by key, in place of a slice by position."""
    return df.where(F.col(col).isin(keys))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def distinct_count(df: DataFrame, col: str, approx: bool = False) -> DataFrame:
    count = F.approx_count_distinct(col) if approx else F.count_distinct(col)
    return df.agg(count.alias("distinct_count"))


def unique_sorted(df: DataFrame, part: list[str], values: str) -> DataFrame:
    """Sorted distinct entries of an array column, by their own type."""
    return df.select(*part, F.array_sort(F.array_distinct(values)).alias("values"))


def arrays_equal(a: Column, b: Column) -> Column:
    """Equality of arrays, nested ones included; two missing arrays are equal, one is not."""
    return a.eqNullSafe(b)


def pack(df: DataFrame, name: str, cols: list[str]) -> DataFrame:
    """Wide record to its name and a map of the other fields, as text."""
    pairs = [p for c in cols for p in (F.lit(c), F.col(c).cast("string"))]
    return df.select(F.col(name).alias("key"), F.create_map(*pairs).alias("values"))


def extents_nd(df: DataFrame, dims: list[str]) -> DataFrame:
    """Extent per dimension in one pass: a dimension with a missing extent is (0, 0), and an
    extent of one value is widened by 1 on both sides."""
    aggs = []
    for d in dims:
        v = to_number(F.col(d))
        aggs += [F.min(v).alias(f"{d}__lo"), F.max(v).alias(f"{d}__hi")]
    row = df.agg(*aggs)
    out = []
    for d in dims:
        lo, hi = F.coalesce(f"{d}__lo", F.lit(0.0)), F.coalesce(f"{d}__hi", F.lit(0.0))
        same = (lo == hi).cast("int")
        out.append(F.struct(F.lit(d).alias("dim"), (lo - same).alias("lo"), (hi + same).alias("hi")))
    return row.select(F.inline(F.array(*out)))


def brush_nd(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows inside every closed range. A missing or non-numeric value passes only where the range
    starts at the minimum of its axis."""
    # one row with the start of every axis, so the table is read once for all of them
    axes = extents_nd(df, list(ranges))
    floors = axes.agg(F.map_from_entries(F.collect_list(F.struct("dim", "lo")))).scalar()

    def passes(dim: str, lo: float, hi: float) -> Column:
        v = to_number(F.col(dim))
        return F.when(v.isNull(), F.lit(float(lo)) == F.element_at(floors, dim)).otherwise(v.between(float(lo), float(hi)))

    return df.where(reduce(lambda a, b: a & b, [passes(d, lo, hi) for d, (lo, hi) in ranges.items()]))


def order_dims(dims: DataFrame) -> DataFrame:
    """Enabled dimensions by position."""
    return dims.where(~F.coalesce("disabled", F.lit(False))).orderBy("position")


def co_sort(values: Column, labels: Column) -> Column:
    """``[{value, label}..]`` by value descending, equal values in their given order."""
    n = F.size(values)
    rows = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct((-F.get(values, i)).alias("d"), i.alias("i"), F.get(labels, i).alias("l")),
    )
    rows = F.when(n > 0, rows).otherwise(F.filter(rows, lambda r: F.lit(False)))
    return F.transform(F.array_sort(rows), lambda r: F.struct((-r["d"]).alias("value"), r["l"].alias("label")))


def range_marks(values: Column) -> dict[str, Column]:
    """Largest, second and smallest of an array; the second is what a bullet range calls mean."""
    down = F.sort_array(values, asc=False)
    return {"max": F.array_max(values), "second": F.get(down, F.lit(1)), "min": F.array_min(values)}
