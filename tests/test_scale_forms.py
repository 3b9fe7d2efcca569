"""Forms that split, sketch or walk what may be large, against plain versions."""
import json
import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from topicloom.operators import ancestry, graph, joins, lookup, output, series, sketches, summary
from topicloom.sources import readers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- bands
def brute_bands(bands, probes):
    out = {}
    for p, chart, x, at in probes:
        hits = [i for c, bx, i, y0, dy in bands if (c, bx) == (chart, x) and None not in (y0, dy, at) and abs(y0) <= abs(at) <= abs(y0) + abs(dy)]
        out[p] = min(hits, default=None)
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("hot", [4_000_000, 7])
def test_bands_that_overlap_and_touch(spark, seed, hot):
    rng = random.Random(seed)
    num = lambda: rng.choice([rng.randint(-12, 12), 0, None]) if rng.random() < 0.3 else rng.randint(0, 12)
    bands = [(c, x, i, num(), rng.choice([0, 1, 2, 3, -2, None])) for c in "ab" for x in (1, 2) for i in range(12)]
    bands = [(c, x, i, None if y is None else float(y), None if d is None else float(d)) for c, x, i, y, d in bands]
    probes = [(k, rng.choice("abc"), rng.choice((1, 2, 3)), rng.choice([None, *[v / 2 for v in range(-6, 30)]])) for k in range(150)]
    s = spark.createDataFrame(bands, "chart string, x int, series_idx int, y0 double, dy double")
    p = spark.createDataFrame(probes, "probe_id int, chart string, x int, at double")
    assert {r.probe_id: r.series_idx for r in lookup.band_at(s, p, hot_rows=hot).collect()} == brute_bands(bands, probes)


def test_bands_of_many_series_at_one_x(spark):
    n = 10_000
    s = spark.range(n).select(F.lit("c").alias("chart"), F.lit(1).alias("x"), F.col("id").cast("int").alias("series_idx"), (F.col("id") * 2.0).alias("y0"), F.lit(2.0).alias("dy"))
    p = spark.range(n).select(F.col("id").alias("probe_id"), F.lit("c").alias("chart"), F.lit(1).alias("x"), (F.col("id") * 2.0 + 1).alias("at"))
    found = lookup.band_at(s, p)
    assert found.where("series_idx = probe_id").count() == n
    assert "CartesianProduct" not in plan(found) and "BroadcastNestedLoopJoin" not in plan(found)


# ---------------------------------------------------------------- nearest, exact types
def test_nearest_keeps_times_and_decimals(spark):
    pts = spark.sql("SELECT 'a' AS k, timestamp_micros(1700000000000001 + 3 * id) AS x, id AS idx, id * 1.0D AS y FROM range(4)")
    probes = spark.sql("SELECT 'a' AS k, 1 AS probe_id, timestamp_micros(1700000000000005) AS at")
    r = lookup.nearest(pts, probes, ["k"]).first()
    assert r.idx == 1 and r.x.microsecond == 4 and r["at"].microsecond == 5
    big = spark.sql("SELECT 'a' AS k, CAST(90071992547409930 + id AS DECIMAL(20, 2)) AS x, id AS idx, 0D AS y FROM range(3)")
    at = spark.sql("SELECT 'a' AS k, 1 AS probe_id, CAST('90071992547409931.00' AS DECIMAL(20, 2)) AS at")
    r = lookup.nearest(big, at, ["k"]).first()
    assert r.idx == 1 and r.x == Decimal("90071992547409931.00")


# ---------------------------------------------------------------- order and stacks
def loop_order(records):
    """Series sorted by peak, each put on the lighter side; ``records`` are (peak, index, key, weight)."""
    top, bottom, tops, bottoms = 0.0, 0.0, [], []
    for _, _, key, w in sorted(records):
        if top < bottom:
            top += w
            tops.append(key)
        else:
            bottom += w
            bottoms.append(key)
    return bottoms[::-1] + tops


def test_order_of_many_series_without_gathering(spark):
    n = 100_000
    rows = spark.range(n).select(
        F.lit("c").alias("chart"), F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 1000).alias("series_idx"),  # indices that repeat
        (F.col("id") * 7919 % 997).alias("x"), (F.col("id") * 31 % 101 + 1).cast("double").alias("y"),
    )
    found = series.series_order(rows)
    assert "collect_list" not in plan(found)
    got = [r.key for r in found.orderBy("pos").collect()]
    want = loop_order([(i * 7919 % 997, i % 1000, f"k{i}", float(i * 31 % 101 + 1)) for i in range(n)])
    assert got == want


def test_order_of_charts(spark):
    rng = random.Random(2)
    rows = [(c, f"s{i}", i, x, float(rng.randint(0, 20))) for c in ("a", "b", None) for i in range(9) for x in range(6)]
    df = spark.createDataFrame(rows, "chart string, key string, series_idx int, x int, y double").repartition(4)
    records = defaultdict(lambda: defaultdict(list))
    for c, k, i, x, y in rows:
        records[c][k].append((i, x, y))
    for c, keys in records.items():
        per = []
        for k, pts in keys.items():
            top = max(p[2] for p in pts)
            per.append((min(p[1] for p in pts if p[2] == top), pts[0][0], k, sum(p[2] for p in pts)))
        got = [r.key for r in series.series_order(df).where(F.col("chart").eqNullSafe(F.lit(c))).orderBy("pos").collect()]
        assert got == loop_order(per)


@pytest.mark.parametrize("offset", ["zero", "expand", "percent", "silhouette", "wiggle"])
def test_stacks_of_many_series_are_split(spark, offset):
    rng = random.Random(4)
    rows = [("c", f"s{i}", i, x, float(rng.randint(0, 9)), i % 7 != 3) for i in range(60) for x in range(3)]
    df = spark.createDataFrame(rows, "chart string, key string, series_idx int, x int, y double, enabled boolean")
    key = lambda r: (r.key, r.x)
    whole = {key(r): (r.y0, r.dy) for r in series.stack(df, offset).collect()}
    cut = {key(r): (r.y0, r.dy) for r in series.stack(df, offset, hot_rows=10).collect()}
    assert whole.keys() == cut.keys() and all(whole[k] == pytest.approx(cut[k]) for k in whole)
    signed = df.withColumn("y", F.col("y") - 4)
    a = {key(r): (r.bar_lo, r.bar_hi) for r in series.signed_stack(signed).collect()}
    assert a == {key(r): (r.bar_lo, r.bar_hi) for r in series.signed_stack(signed, hot_rows=10).collect()}


# ---------------------------------------------------------------- first and last
def test_first_and_last_without_sort_aggregation(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["g", "h", None]), rng.randint(0, 3), i, float(rng.randint(0, 50))) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, t int, i int, v double")
    bars = summary.ohlc(df, ["g"], F.lit(0), ["t", "i"], "v")
    assert "SortAggregate" not in plan(bars)
    for r in bars.collect():
        own = sorted((t, i, v) for g, t, i, v in rows if g == r.g)
        assert (r.open, r.close, r.high, r.low) == (own[0][2], own[-1][2], max(o[2] for o in own), min(o[2] for o in own))
    points = df.select(F.lit("c").alias("chart"), F.col("g").alias("key"), (F.col("i") * 2).alias("x"), F.col("i").alias("idx"), F.col("v").alias("y"))
    found = series.spark_points(points)
    assert "SortAggregate" not in plan(found)
    for r in found.collect():
        own = [(v, i) for g, _, i, v in rows if g == r.key]
        assert (r.min_x, r.max_x) == (2 * min(own)[1], 2 * max(own)[1]) and r.last_x == 2 * max(i for _, i in own)


# ---------------------------------------------------------------- sketches
def test_rank_error_of_merged_quantile_sketches(spark):
    df = spark.range(60_000).select(F.expr("CASE WHEN id % 3 = 0 THEN 'a' END").alias("g"), (F.col("id") % 20).alias("b"), (F.pmod(F.xxhash64("id"), F.lit(100_003)) / 7.0).alias("v"))
    made = sketches.quantile_sketches(df, ["g"], F.col("b"), "v")
    ps = [0.01, 0.25, 0.5, 0.75, 0.99]
    for lo, hi in ((None, None), (3, 11), (5, 5)):
        rows = df.where(F.lit(True) if lo is None else F.col("b").between(lo, hi)).collect()
        by = defaultdict(list)
        for r in rows:
            by[r.g].append(r.v)
        got = sketches.sketched_quantiles(made, ["g"], ps, lo, hi).collect()
        assert len(got) == 10
        for r in got:
            values = by[r.g]
            rank = sum(v <= r.value for v in values) / len(values)
            assert r.n == len(values) and abs(rank - r.probability) <= sketches.RANK_ERROR + 1 / len(values)


def test_error_of_united_distinct_sketches(spark):
    df = spark.range(50_000).select((F.col("id") % 10).alias("b"), (F.col("id") * 7 % 13_001).alias("u"))
    made = sketches.distinct_sketches(df, [], F.col("b"), "u")
    for lo, hi in ((None, None), (2, 4), (9, 9)):
        exact = df.where(F.lit(True) if lo is None else F.col("b").between(lo, hi)).select("u").distinct().count()
        found = sketches.sketched_distinct(made, [], lo, hi).first().distinct_count
        assert abs(found - exact) <= sketches.COUNT_ERROR * exact


# ---------------------------------------------------------------- ancestors
def test_ancestors_of_a_long_chain_and_cycles(spark):
    n = 1000
    links = [(i, i - 1 if i else None) for i in range(n)] + [(5000, 5001), (5001, 5002), (5002, 5000), (6000, 5001), (7000, 7000), (8000, 77_000)]
    df = spark.createDataFrame(links, "node long, parent long").repartition(4)
    pairs = ancestry.ancestor_pairs(df)
    assert pairs.where("node < 1000").count() == n * (n - 1) // 2
    assert pairs.where("node < 1000 and distance <> node - ancestor").isEmpty()
    assert [tuple(r) for r in pairs.where("node >= 1000").collect()] == [(8000, 77_000, 1)]
    assert sorted(r.node for r in ancestry.cyclic_nodes(df).collect()) == [5000, 5001, 5002, 6000, 7000]


def test_jumps_end_with_the_longest_chain_and_hold_open_nodes_only(spark):
    n = 400
    links = [(i, (i + 1) % n) for i in range(n)] + [(1000 + i, 1001 + i if i < 5 else None) for i in range(6)] + [(2000 + i, 2000 if i else 7) for i in range(50)]
    levels, looping = ancestry._settled(ancestry._jumps(spark.createDataFrame(links, "node long, parent long"), "node", "parent"))
    assert len(levels) <= 5 and levels[2].count() == n + 50 + 2
    assert sorted(r.node for r in looping.collect()) == [*range(n), *range(2000, 2050)]


def test_ancestors_of_random_forests(spark):
    rng = random.Random(6)
    links = [(i, rng.choice([None, rng.randrange(i)]) if i else None) for i in range(200)]
    up = dict(links)
    want = set()
    for i in up:
        at, d = up[i], 1
        while at is not None:
            want.add((i, at, d))
            at, d = up[at], d + 1
    got = ancestry.ancestor_pairs(spark.createDataFrame(links, "node long, parent long")).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


# ---------------------------------------------------------------- trees and files
MIXED = [
    {"name": "flare", "children": [
        {"name": "analytics", "children": [{"name": "cluster", "children": [{"name": "Agglomerative", "size": 3938.0}, {"name": "Merge", "size": 743.0}]}, {"name": "Lone", "size": 5.0}]},
        {"name": "animate", "size": 17010.0}]},
    {"name": "query \"q\"", "children": [{"name": "deep", "children": [{"name": "er", "children": [{"name": "est", "children": [{"name": "leaf", "size": 1.5}]}]}]}]},
    {"name": "only", "size": 2.0}, {"name": "bare"},
]


def unfolded(nodes, path=(), at=()):
    for i, node in enumerate(nodes):
        p, o = (*path, node["name"]), (*at, i)
        if node.get("children"):
            yield from unfolded(node["children"], p, o)
        else:
            yield list(p), list(o), node["name"], node.get("size")


def test_trees_of_mixed_depth_read_and_write_back(spark, tmp_path):
    whole, lines = tmp_path / "whole.json", tmp_path / "lines"
    whole.write_text(json.dumps({"data": {"name": "root", "children": MIXED}}, indent=2))
    lines.mkdir()
    (lines / "a.json").write_text("\n".join(map(json.dumps, MIXED[:2])) + "\n\n")
    (lines / "b.json").write_text("\n".join(map(json.dumps, MIXED[2:])))
    want = sorted(map(list, unfolded(MIXED)), key=lambda r: r[1])
    for leaves in (readers.read_tree(spark, str(whole), whole=True), readers.read_tree(spark, str(lines))):
        assert [list(r) for r in leaves.orderBy("ord").collect()] == want
        back = [json.loads(r.document) for r in output.nested_documents(leaves).orderBy("ord").collect()]
        assert back == MIXED


def test_lines_are_numbered_over_files_and_splits(spark, tmp_path):
    want = []
    for f in range(3):
        rows = [f"{f},{i},{'x' * (i % 40)}" for i in range(4000 if f < 2 else 3)]
        (tmp_path / f"part-{f}.csv").write_text("\n".join(rows) + "\n" + (" \n" if f == 1 else ""))
        want += rows
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = readers.file_lines(spark, str(tmp_path))
        assert "Exchange" not in plan(got).replace("BroadcastExchange", "")
        assert [r.value for r in got.orderBy("line").collect()] == want
        assert [r.line for r in got.orderBy("line").collect()] == list(range(len(want)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_fields_of_nodes_of_any_form(spark):
    df = spark.createDataFrame([('{"name": "x", "group": 1, "o": {"p": 1}}',), ('{"name": "y", "group": 2.5, "we ird": null}',), ("[1]",), ("no json",), (None,)], "node string")
    got = {r.field: r.type for r in graph.field_types(df, "node").collect()}
    assert set(got) == {"name", "group", "o", "we ird"} and got["name"] == "STRING" and got["o"] == "OBJECT<p: BIGINT>" and got["group"].startswith("DECIMAL")


def test_names_of_a_column_are_bounded(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "k string")
    assert output.names_of(df, "k") == ["a", "b"]
    assert output.names_of(df.limit(0), "k") == []
    with pytest.raises(ValueError, match="long form"):
        output.names_of(df, "k", limit=1)


def test_keyed_diff_by_several_keys(spark):
    rows = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (1, "b", 3), (2, "c", 4)], "topic long, word string, weight long")
    out = joins.keyed_diff(rows, rows.withColumn("topic", F.col("topic") - 1), ["topic", "word"], "weight")
    assert sorted(map(tuple, out.select("topic", "word", "old_value", "new_value", "status").collect()), key=repr) == sorted([
        (-1, "a", None, 1, "added"), (-1, "b", None, 2, "added"), (0, "a", 1, None, "removed"), (0, "b", 2, 3, "kept"),
        (1, "b", 3, None, "removed"), (1, "c", None, 4, "added"), (2, "c", 4, None, "removed"),
    ], key=repr)
