"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_zero(x: Column) -> Column:
    """Null, NaN and both infinities become 0."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(x)


def safe_divide(a: Column, b: Column) -> Column:
    """``a / b``, null where ``b`` is 0 or null."""
    return F.when(b != 0, a / b)


def error_interval(e: Column, is_array: bool = False) -> Column:
    """``[-|e|, |e|]`` from one number; a pair is passed through."""
    return e if is_array else F.array(-F.abs(e), F.abs(e))


def link_width(value: Column) -> Column:
    return F.sqrt(value)


def to_number(x: Column) -> Column:
    """Number held in a text or numeric column; missing, non-numeric and NaN give null."""
    v = x.try_cast("double")
    return F.when(~F.isnan(v), v)
