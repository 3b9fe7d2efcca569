from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.llm import cube
from topicloom.llm.common import texts


@pytest.mark.parametrize("seed", range(6))
def test_flight_keeps_both_totals(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 9 if seed % 2 else 5000, 400).astype(float)
    psi = np.full(400, 0.37)
    out = cube.flight(sizes, psi, rng)
    open_ = (out > cube.NEAR) & (out < 1 - cube.NEAR)
    assert open_.sum() <= 2 and out.sum() == pytest.approx(psi.sum()) and sizes @ out == pytest.approx(sizes @ psi)


def test_inclusion_probabilities_are_kept():
    sizes = np.array([5.0, 9, 2, 40, 7, 7, 1, 3])
    drawn = np.mean([cube.flight(sizes, np.full(8, 0.3), np.random.default_rng(s)) for s in range(4000)], axis=0)
    assert np.abs(drawn - 0.3).max() < 0.03


def fill(sizes):
    """Targets by sharing the excess anew until none is above its limit."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + ([None] if None in sizes else [])
    weight = {n: 1 + k % 3 for k, n in enumerate(names)}
    full, total = {}, float(sum(sizes.values()))
    while True:
        left = [n for n in names if n not in full]
        rest = total - sum(full.values())
        share = {n: rest * weight[n] / sum(weight[m] for m in left) for n in left}
        over = [n for n in left if share[n] > 3 * sizes[n]]
        if not over:
            return {**full, **share}
        full.update({n: 3.0 * sizes[n] for n in over})


@pytest.mark.parametrize("block", [3, 20_000])
def test_mix(spark, awkward, block):
    got = cube.mix(texts(awkward, keep=["source"]), block=block).collect()
    assert len(got) == awkward.count()
    size = defaultdict(int)
    for r in awkward.select("source", "text").collect():
        size[r.source] += len((r.text or "").encode().split())
    want, taken = fill(size), defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    largest = max(r.size for r in got)
    for name, t in want.items():
        assert abs(taken[name] - t) <= largest
    again = cube.mix(texts(awkward.repartition(5), keep=["source"]), block=block).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_many_documents_meet_the_targets(spark):
    docs = spark.range(900).select(
        F.col("id").alias("doc_id"), F.expr("CASE WHEN id < 500 THEN 'hot' WHEN id < 503 THEN 'tiny' ELSE concat('s', id % 3) END").alias("source"),
        F.expr("repeat('w ', cast(1 + (id * 7919) % 97 as int))").alias("text"),
    )
    sums = cube.mix(docs, block=50).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 97 for r in sums) and len(sums) == 5


def test_empty_table(empty):
    assert cube.mix(texts(empty, keep=["source"])).count() == 0


def test_small_blocks_end(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.expr("repeat('w ', cast(1 + id % 7 as int))").alias("text"))
    one = docs.union(docs.selectExpr("doc_id + 100", "'t'", "text"))
    got = cube.mix(one, block=3)
    assert got.count() == 80
    assert all(abs(r.t - r.g) <= 7 for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect())
    with pytest.raises(ValueError):
        cube.mix(one, block=2)


def test_rows_that_repeat_one_id_are_spread(spark):
    docs = spark.range(300).select(F.lit(None).cast("long").alias("doc_id"), F.expr("CASE WHEN id < 150 THEN 'a' ELSE 'b' END").alias("source"), F.lit("w w").alias("text"))
    got = cube.mix(docs, block=10)
    assert got.count() == 300
    assert all(abs(r.t - r.g) <= 2 for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect())
