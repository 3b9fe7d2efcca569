"""Running aggregates over an order that survive a group holding a large part of all rows.

A plain ``OVER (PARTITION BY g ORDER BY x)`` sorts a whole group in one task. Where a group has more
than ``hot_rows`` rows, the rows are first range-partitioned by group and order columns themselves, so
that every type, null and special value falls where the window would put it, and stored with the
number of their range. A range of a group is a block: blocks are scanned in tasks of their own, and
the totals of the blocks before (or after) it are added. The stored numbers are the same for every
later evaluation, also one after an executor loss.

Rows that are equal in all order columns share a block, however many they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

HOT_ROWS = 4_000_000
#: Ranges in all. Each puts sampled rows, a task's result and a file's name on the driver, so beyond this blocks grow instead.
MOST_RANGES = 2_000
WHOLE = "__whole"
BLOCK = "__block"


@dataclass(frozen=True)
class Running:
    """One running aggregate.

    ``fn`` is sum, max or min. ``frame`` tells which rows count: ``before`` or ``upto`` the row,
    ``after`` it or ``from`` it on.
    """

    fn: str
    value: Column
    frame: str = "upto"


_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _frame(part: list[str], orders: list[str], frame: str):
    """Window for a frame. Frames that look ahead run backwards over the reversed order: a frame
    with an unbounded end is computed anew for every row."""
    by = [F.col(o).asc_nulls_first() for o in orders]
    if frame in ("from", "after"):
        by = [F.col(o).desc_nulls_last() for o in orders]
    last = Window.currentRow if frame in ("upto", "from") else -1
    return Window.partitionBy(*part).orderBy(*by).rowsBetween(Window.unboundedPreceding, last)


def _combine(fn: str, near: Column, carried: Column) -> Column:
    if fn == "sum":
        return F.coalesce(near + carried, near, carried)
    return F.greatest(near, carried) if fn == "max" else F.least(near, carried)


def _blocks(rows: DataFrame, part: list[str], orders: list[str], out: dict[str, Running], hot_rows: int) -> DataFrame | None:
    """Rows with their block and the totals around it; None where no group is hot."""
    sizes = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    if sizes["most"] is None or sizes["most"] <= hot_rows:
        return None
    ranges = min(-(-2 * sizes["all"] // hot_rows), MOST_RANGES)
    by = [F.col(c).asc_nulls_first() for c in part + orders]
    dealt = materialise(rows.repartitionByRange(ranges, *by).withColumn(BLOCK, F.spark_partition_id()), "blocks")
    totals = dealt.groupBy(*part, BLOCK).agg(*[_AGG[r.fn](f"__v_{n}").alias(f"__t_{n}") for n, r in out.items()])
    ahead = {"upto": "before", "before": "before", "from": "after", "after": "after"}
    carry = totals.select(
        *[F.col(k).alias(f"__key_{k}") for k in part + [BLOCK]],
        *[_AGG[r.fn](f"__t_{n}").over(_frame(part, [BLOCK], ahead[r.frame])).alias(f"__b_{n}") for n, r in out.items()],
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in part + [BLOCK]])
    return dealt.join(carry, same).drop(*[f"__key_{k}" for k in part + [BLOCK]])


def ordered_scan(
    df: DataFrame,
    part: list[str],
    order: list[Column | str],
    out: dict[str, Running],
    hot_rows: int | None = HOT_ROWS,
    keep: Callable[[dict[str, Column]], Column] | None = None,
) -> DataFrame:
    """Add running aggregates ``out`` along ``order`` (ascending, nulls first) within ``part``.

    ``keep`` may give a condition on the totals carried into a block; blocks that fail it are
    left out before their rows are shuffled. ``hot_rows=None`` is for groups with a known small
    bound and gives the plain window.

    ``df`` is read once, in its group columns, to look for hot groups, and once for the result. With a
    hot group its rows are stored. An expensive ``df`` should be stored first, see
    :func:`topicloom.session.materialise`.
    """
    columns = df.columns
    part = list(part) or [WHOLE]
    extra = {WHOLE: F.lit(0)} if part == [WHOLE] else {}
    orders = {f"__o{i}": F.col(o) if isinstance(o, str) else o for i, o in enumerate(order)}
    rows = df.withColumns({**extra, **orders, **{f"__v_{n}": r.value for n, r in out.items()}})

    cells: list[str] = []
    if hot_rows is not None:
        split = _blocks(rows, part, list(orders), out, hot_rows)
        if split is not None:
            cells, rows = [BLOCK], split
            if keep is not None:
                rows = rows.where(keep({n: F.col(f"__b_{n}") for n in out}))
            # asked for by name: a child already split by `part` alone would keep a hot group whole
            rows = rows.repartition(*part, BLOCK)

    results = {}
    for n, r in out.items():
        near = _AGG[r.fn](f"__v_{n}").over(_frame(part + cells, list(orders), r.frame))
        results[n] = _combine(r.fn, near, F.col(f"__b_{n}")) if cells else near
    return rows.select(*[c for c in columns if c not in results], *[c.alias(n) for n, c in results.items()])


def row_number(df: DataFrame, part: list[str], order: list[Column | str], name: str = "rn",
               hot_rows: int | None = HOT_ROWS, start: int = 1) -> DataFrame:
    """Position of each row within its group, counted from ``start``."""
    one = F.lit(1).cast("bigint")
    numbered = ordered_scan(df, part, order, {name: Running("sum", one, "upto")}, hot_rows)
    return numbered if start == 1 else numbered.withColumn(name, F.col(name) + (start - 1))
