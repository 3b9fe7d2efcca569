"""Topic-similarity graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import link_width
from .scan import HOT_ROWS, ordered_scan, Running


def threshold_symmetric(sim: DataFrame, t: float = 0.1) -> DataFrame:
    """Zero both cells of a pair whose lower-triangle cell is below ``t``; the diagonal stays.

    The two cells of a pair meet in one aggregation and are written out again, so the matrix is
    shuffled once and not joined with itself.
    """
    hi, lo = F.greatest("i", "j"), F.least("i", "j")
    low = F.max(F.when(F.col("i") >= F.col("j"), F.col("sim")))
    up = F.max(F.when(F.col("i") < F.col("j"), F.col("sim")))
    pairs = sim.groupBy(hi.alias("hi"), lo.alias("lo")).agg(low.alias("low"), up.alias("up"))
    cut = (F.col("hi") != F.col("lo")) & (F.col("low") < t)

    def cell(i: str, j: str, v: str) -> Column:
        value = F.when(F.coalesce(cut, F.lit(False)), F.lit(0.0)).otherwise(F.col(v))
        return F.struct(F.col(i).alias("i"), F.col(j).alias("j"), value.alias("sim"))

    mirrored = F.when(F.col("hi") != F.col("lo"), cell("lo", "hi", "up"))
    both = F.filter(F.array(cell("hi", "lo", "low"), mirrored), lambda c: c["sim"].isNotNull())
    return pairs.select(F.inline(both))


def rank_edges(sim: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Cells of each row by similarity descending; equal cells by column."""
    one = F.lit(1).cast("bigint")
    return ordered_scan(sim, ["i"], [F.col("sim").isNull(), -F.col("sim"), F.col("j")], {"rank": Running("sum", one)}, hot_rows)


def group_sums(sim: DataFrame) -> DataFrame:
    """Total of each matrix row, the size of its group."""
    return sim.groupBy("i").agg(F.sum("sim").alias("value"))


def matrix_long(wide: DataFrame, row: str, cols: list[str]) -> DataFrame:
    """Named matrix columns to ``(i, j, sim)`` with the position of the column as ``j``."""
    cells = F.array(*[F.col(c) for c in cols])
    return wide.select(F.col(row).alias("i"), F.posexplode(cells).alias("j", "sim"))


def field_set(nodes: DataFrame, fields: str) -> DataFrame:
    """Names of all fields that occur in a map column."""
    return nodes.select(F.explode(F.map_keys(F.col(fields))).alias("field")).distinct()


def field_types(nodes: DataFrame, node: str) -> DataFrame:
    """``(field, type)``: the fields of JSON objects of any form, each with the type that holds all its values.

    The types of a field are merged before the shuffle. A text that is no object adds nothing.
    """
    parsed = nodes.select(F.try_parse_json(node).alias("__v")).where(F.schema_of_variant("__v").startswith("OBJECT"))
    fields = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("__v").outer()))
    return fields.groupBy(F.col("key").alias("field")).agg(F.schema_of_variant_agg("value").alias("type")).where(F.col("field").isNotNull())


def edge_widths(edges: DataFrame, value: str) -> DataFrame:
    return edges.withColumn("width", link_width(F.col(value)))
