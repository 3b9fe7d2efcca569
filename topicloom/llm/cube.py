"""Mixing sources to target weights by balanced sampling with the cube method.

Each source has a target, a number of words. A document is taken ``floor(r)`` times for the ratio
``r`` of target to source size, and once more with the remaining probability. Which documents are
taken once more is drawn by the cube method: the probabilities move inside the null-space of the
balancing constraints (number of words, number of documents), so both totals stay as they are, until
each probability but a few has become 0 or 1 (flight). A block of a source is flown in one task and
leaves at most two fractional documents; what the blocks of a source leave is flown again, in blocks
of the same bound, until one block is left. Its last documents (landing) are rounded so that the
words come nearest to the total, and a few exchanges of documents of that block make up the rest.

Randomness comes from the source's rank, level and block alone, and rows are sorted within a block:
reruns agree. A null source is a source of its own, the last one. A null text has size 0 and is never
taken. Repeated rows are drawn each for itself. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, small, stored

BLOCK = 20_000
WEIGHTS = (1, 2, 3)
MOST = 3
NEAR = 1e-9
MOST_SWAPS = 4
SMALL_SOURCES = 10_000  # rows of the table of sources that are broadcast


def flight(sizes: np.ndarray, psi: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move ``psi`` until at most two entries are neither 0 nor 1.

    Sums of ``psi`` and of ``sizes * psi`` are kept; all documents began with one probability, so
    these are the balancing constraints.
    """
    psi = psi.tolist()
    x = sizes.tolist()
    draws = rng.random(len(psi))
    active: list[int] = []
    for k, draw in zip(range(len(psi)), draws, strict=True):
        if not NEAR < psi[k] < 1 - NEAR:
            psi[k] = float(round(psi[k]))
            continue
        active.append(k)
        if len(active) < 3:
            continue
        a, b, c = active
        u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])  # orthogonal to (1, 1, 1) and to the sizes
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - psi[i]) / v if v > 0 else psi[i] / -v for i, v in zip(active, u, strict=True) if v)
        down = min(psi[i] / v if v > 0 else (1 - psi[i]) / -v for i, v in zip(active, u, strict=True) if v)
        step = up if draw * (up + down) < down else -down
        left = []
        for i, v in zip(active, u, strict=True):
            psi[i] += step * v
            if NEAR < psi[i] < 1 - NEAR:
                left.append(i)
            else:
                psi[i] = float(round(psi[i]))
        active = left
    return np.array(psi)


def land(sizes: np.ndarray, psi: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Round the at most two fractional entries so that the words come nearest to their total.

    What is still missing is made up by exchanging a taken document for one that is not, as long as
    that brings the words nearer; the number of documents stays. ``start`` holds the probabilities
    before the flight.
    """
    open_ = np.flatnonzero((psi > NEAR) & (psi < 1 - NEAR))
    trials = []
    for bits in range(1 << len(open_)):
        trial = psi.copy()
        trial[open_] = [bits >> j & 1 for j in range(len(open_))]
        trials.append((abs(float(sizes @ (trial - start))), abs(float((trial - start).sum())), bits, trial))
    out = min(trials, key=lambda t: t[:3])[3].round()
    free = (start > NEAR) & (start < 1 - NEAR)
    for _ in range(MOST_SWAPS):
        over = float(sizes @ (out - start))
        inside, outside = np.flatnonzero(free & (out == 1)), np.flatnonzero(free & (out == 0))
        if not len(inside) or not len(outside):
            break
        outside = outside[np.argsort(sizes[outside], kind="stable")]
        want = sizes[inside] - over
        at = np.clip(np.searchsorted(sizes[outside], want), 1, len(outside) - 1) if len(outside) > 1 else np.zeros(len(inside), int)
        near = np.stack([np.maximum(at - 1, 0), at])
        off = np.abs(over + sizes[outside][near] - sizes[inside])
        k = int(off.argmin())
        if off.flat[k] >= abs(over) - NEAR:
            break
        side, i = divmod(k, len(inside))
        out[inside[i]], out[outside[near[side, i]]] = 0, 1
    return out


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add ``rank`` and ``target`` to ``(source, source_size)``.

    Weights repeat along the sources by code point, null last, and share the sum of all sizes; a
    target stops at ``most`` times its source's size and the rest is shared anew by weight. The water
    level is the largest of the levels reached as sources fill up in the order of ``size / weight``.
    One row per source passes through the windows here.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)
    ranked = ranked.withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    full = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole = Window.partitionBy()
    open_ = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    levels = ranked.withColumn("level", (F.sum("source_size").over(whole) - full) / open_)
    return levels.withColumn("target", F.least("cap", F.col("weight") * F.max("level").over(whole))).drop("weight", "cap", "level")


def _fly(level: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rank, block = int(key[0]), int(key[1])
        pdf = pdf.sort_values(["doc_id", "size"], na_position="first", kind="stable").reset_index(drop=True)
        sizes, psi = pdf["size"].to_numpy(float), pdf["psi"].to_numpy(float)
        flown = flight(sizes, psi, np.random.default_rng([rank, level, block]))
        if pdf["blocks"].iloc[0] == 1:
            flown = land(sizes, flown, psi)
        return pdf.assign(psi=flown)

    return run


def _salted(sized: DataFrame, block: int) -> DataFrame:
    """Add ``salt``: 0, but for rows that repeat one id and size more often than a block holds, which
    would else share a block, a hash of their place in the stored files."""
    many = sized.groupBy("doc_id", "size").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    many = stored(many.select(F.col("doc_id").alias("__id"), F.col("size").alias("__size")), "repeated-sizes")
    if many.isEmpty():
        return sized.withColumn("salt", F.lit(0).cast("bigint"))
    place = F.xxhash64("_metadata.file_name", "_metadata.row_index")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("size") == F.col("__size"))
    met = sized.withColumn("salt", place).join(small(many), same, "left")
    return met.withColumn("salt", F.when(F.col("__size").isNotNull(), F.col("salt")).otherwise(F.lit(0))).drop("__id", "__size")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)`` and the columns ``keep`` for ``docs`` (``doc_id``,
    ``source``, non-null ``text``): how often the mix takes each document, and how many words that is."""
    if block < 3:
        raise ValueError("a block needs three documents: it leaves up to two")
    sized = stored(
        docs.select(F.col("doc_id"), F.col("source").cast("string"), F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("size"), *keep), "sizes"
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    base = F.floor(ratio + NEAR)
    plan = targets(totals, weights, most).withColumns({
        "copies": base.cast("bigint"), "psi": F.greatest(ratio - base, F.lit(0.0)), "blocks": F.ceil(F.col("n_docs") / block),
    })
    plan = stored(plan.withColumnRenamed("source", "__source").drop("n_docs"), "sources")
    if plan.count() <= SMALL_SOURCES:
        plan = F.broadcast(plan)  # else the engine splits a source with many rows
    rest = _salted(sized, block).join(plan, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    fractional = (F.col("psi") > NEAR) & (F.col("psi") < 1 - NEAR)
    decided = [rest.where(~fractional)]
    rest = rest.where(fractional)
    level = 0
    while True:
        spread = rest.withColumn("block", F.pmod(F.when(F.col("salt") == 0, F.xxhash64("doc_id", "size", F.lit(level))).otherwise(F.xxhash64("salt", F.lit(level))), F.col("blocks")))
        flown = spread.repartition("rank", "block").groupBy("rank", "block").applyInPandas(_fly(level), spread.schema)
        flown = stored(flown, "flight").drop("block")
        decided.append(flown.where(~fractional))
        # a block leaves two documents at most, which bounds the next level's blocks; there are fewer at every level
        fewer = F.greatest(F.lit(1), F.least(F.col("blocks") - 1, F.ceil(2 * F.col("blocks") / block)))
        rest = flown.where(fractional).withColumn("blocks", fewer)
        level += 1
        if rest.isEmpty():
            break
    columns = ["doc_id", "source", "size", "source_size", "target", "copies", "psi", *keep]
    out = reduce(DataFrame.unionByName, [d.select(*columns) for d in decided])
    copies = (F.col("copies") + F.round("psi")).cast("bigint")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), *keep)
