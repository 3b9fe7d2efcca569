"""Bin expressions. Both rules are closed forms, so no array of borders is searched per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def border(k: Column, lo: int, hi: int, n: int) -> Column:
    """Left border of bin ``k``: ``lo + floor(k * (hi - lo) / n)`` in integers."""
    return F.lit(lo).cast("bigint") + F.call_function(
        "div", k.cast("bigint") * F.lit(hi - lo).cast("bigint"), F.lit(n).cast("bigint")
    )


def borders(lo: int, hi: int, n: int) -> Column:
    """All ``n`` left borders as one array."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: border(k, lo, hi, n))


def bin_left(x: Column, lo: int, hi: int, n: int) -> Column:
    """Largest integer border that is ``<= x``; values past the last border stay in the last bin.

    ``border(k) <= x`` holds exactly when ``k * (hi - lo) < (x - lo + 1) * n`` for integer ``x``,
    which gives the bin number by one integer division. Null and below-range values give null.
    """
    span, bins = F.lit(hi - lo).cast("bigint"), F.lit(n).cast("bigint")
    d = F.floor(x).cast("bigint") - F.lit(lo).cast("bigint")
    # beyond the range the answer is the last bin anyway, and the product below stays small
    d = F.least(d, span)
    k = F.least(F.call_function("div", (d + 1) * bins - 1, span), bins - 1)
    return F.when(x.isNotNull() & (d >= 0), border(k, lo, hi, n))


def bin_right_closed(x: Column, lo: Column, hi: Column, n: int) -> Column:
    """Number of the equal-width bin ``(a, b]`` that holds ``x``; the lowest value joins bin 0."""
    width = (hi - lo) / F.lit(float(n))
    k = F.greatest(F.lit(0), F.ceil((x - lo) / F.nullif(width, F.lit(0.0))).cast("int") - 1)
    inside = (x >= lo) & (x <= hi)
    return F.when(inside, F.coalesce(F.least(k, F.lit(n - 1)), F.lit(0)))


def bin_right_closed_edge(k: Column, lo: Column, hi: Column, n: int) -> Column:
    """Left edge of bin ``k``; the first one is moved down by 0.1 % of the range."""
    width = (hi - lo) / F.lit(float(n))
    return F.when(k == 0, lo - (hi - lo) * F.lit(0.001)).otherwise(lo + k * width)
