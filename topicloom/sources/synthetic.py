"""Generated inputs. Every value is a function of its row number and the seed, not of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shares import row_shares


def uniform(*of: Column) -> Column:
    """Number in (0, 1) from a hash of the arguments."""
    return (F.pmod(F.xxhash64(*of), F.lit(2**52)) + 0.5) / F.lit(float(2**52))


def exponential_row(ident: Column, k: int, seed: int) -> Column:
    """``k`` exponential draws divided by their sum: a flat Dirichlet row."""
    draws = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda j: -F.ln(uniform(ident, j, F.lit(seed))))
    return row_shares(draws)


def gen_doc_topic(source: SparkSession | DataFrame, k: int, lo: int, hi: int, seed: int, n: int | None = None) -> DataFrame:
    """``doc_id, weights, ts``: for ``n`` new documents, or for every ``doc_id`` of a table."""
    ids = source.range(n).select(F.col("id").alias("doc_id")) if isinstance(source, SparkSession) else source.select("doc_id")
    moment = F.lit(lo) + F.floor(uniform(F.col("doc_id"), F.lit(seed), F.lit("date")) * F.lit(hi - lo))
    return ids.select(
        "doc_id", exponential_row(F.col("doc_id"), k, seed).alias("weights"), moment.cast("bigint").alias("ts")
    )


def wave(i: Column, j: Column, m: Column) -> Column:
    """Layer ``i`` at step ``j`` of ``m``: ``2x exp(-x/2)`` with ``x = 20 j/m - i/3``, at least 0."""
    x = F.lit(20.0) * j / m - i / F.lit(3.0)
    return F.greatest(F.lit(0.0), 2.0 * x * F.exp(-0.5 * x))


def gen_waves(source: SparkSession | DataFrame, n: int, m: int) -> DataFrame:
    """Series ``(series_idx, x, y)``; a given table supplies its own ``series_idx`` column."""
    layers = source.range(n).select(F.col("id").alias("series_idx")) if isinstance(source, SparkSession) else source.select("series_idx")
    steps = layers.select("series_idx", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("x"))
    return steps.select("series_idx", "x", wave(F.col("series_idx"), F.col("x"), F.lit(float(m))).alias("y"))
