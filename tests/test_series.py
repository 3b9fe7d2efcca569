import random

import pytest
from pyspark.sql import functions as F

from topicloom.operators import lookup
from topicloom.operators import series as S

POINTS = [("Series 1", 0, [(-1, -3), (0, 6), (1, 12), (2, 18)]), ("Series 2", 1, [(-1, -4), (0, 7), (1, 13), (2, 14)])]


def make(spark, table):
    rows = [("c", k, i, x, None if y is None else float(y)) for k, i, pts in table for x, y in pts]
    return spark.createDataFrame(rows, "chart string, key string, series_idx int, x long, y double")


@pytest.fixture(scope="module")
def two(spark):
    return make(spark, POINTS)


@pytest.fixture(scope="module")
def layers(spark):
    rnd = random.Random(11)
    data = [[round(rnd.random() * 9 + 0.5, 3) for _ in range(12)] for _ in range(4)]
    return data, make(spark, [(f"s{i}", i, list(enumerate(v))) for i, v in enumerate(data)])


def baseline(data):
    """Wiggle baseline, plain loops."""
    n, m, o, out = len(data), len(data[0]), 0.0, [0.0]
    for j in range(1, m):
        s1 = sum(data[i][j] for i in range(n))
        s2 = 0.0
        for i in range(n):
            s3 = (data[i][j] - data[i][j - 1]) / 2 + sum(data[k][j] - data[k][j - 1] for k in range(i))
            s2 += s3 * data[i][j]
        o -= s2 / s1
        out.append(o)
    low = min(0.0, min(out))
    return [v - low for v in out]


@pytest.mark.parametrize("hot", [None, 3])
def test_wiggle(layers, hot):
    data, df = layers
    base = baseline(data)
    for r in S.stack(df, "wiggle", hot_rows=hot).collect():
        want = base[r.x] + sum(data[k][r.x] for k in range(r.series_idx))
        assert abs(r.y0 - want) < 1e-9 and r.dy == r.y


def test_other_offsets(layers):
    data, df = layers
    total = [sum(v[j] for v in data) for j in range(12)]
    for r in S.stack(df, "silhouette").collect():
        want = (max(total) - total[r.x]) / 2 + sum(data[k][r.x] for k in range(r.series_idx))
        assert abs(r.y0 - want) < 1e-9
    tops = S.stack(df, "expand").groupBy("x").agg(F.max(F.col("y0") + F.col("dy")).alias("t")).collect()
    assert all(abs(r.t - 1) < 1e-12 for r in tops)
    hidden = df.withColumn("enabled", F.col("key") != "s1")
    for r in S.stack(hidden, "percent").collect():
        assert abs(r.dy - data[r.series_idx][r.x] / total[r.x]) < 1e-12


def test_expand_and_percent_at_zero_total(spark):
    flat = make(spark, [("a", 0, [(0, 0)]), ("b", 1, [(0, 0)])])
    assert [r.dy for r in S.stack(flat, "expand").collect()] == [0.5, 0.5]
    assert [r.dy for r in S.stack(flat, "percent").collect()] == [0.0, 0.0]


def test_inside_out_order(layers):
    data, df = layers
    peak = [v.index(max(v)) for v in data]
    top = bottom = 0.0
    tops, bottoms = [], []
    for j in sorted(range(4), key=lambda i: (peak[i], i)):
        if top < bottom:
            top += sum(data[j])
            tops.append(j)
        else:
            bottom += sum(data[j])
            bottoms.append(j)
    got = [r.series_idx for r in S.series_order(df).orderBy("pos").collect()]
    assert got == bottoms[::-1] + tops


def test_signed_stack(two):
    got = {(r.key, r.x): (r.bar_lo, r.bar_hi) for r in S.signed_stack(two).collect()}
    assert got[("Series 1", -1)] == (-3, 0) and got[("Series 2", -1)] == (-7, -3)
    assert got[("Series 2", 2)] == (18, 32)
    alone = {(r.key, r.x): (r.bar_lo, r.bar_hi) for r in S.signed_stack(two, ["Series 1"]).collect()}
    assert alone[("Series 2", 2)] == (0, 14) and alone[("Series 1", 2)] == (0, 18)


def test_rebase(two):
    idx = S.point_index(two)
    got = {(r.key, r.x): (r.display, r.off) for r in S.rebase(idx, 1).collect()}
    assert got[("Series 1", 0)] == (0.0, False) and abs(got[("Series 1", 2)][0] - 12 / 7) < 1e-12
    assert got[("Series 2", -1)][0] == pytest.approx(-11 / 8)
    assert all(v[1] for v in {r.x: (r.display, r.off) for r in S.rebase(idx, 0).collect()}.values())
    assert all(r.display == r.y and not r.off for r in S.rebase(idx, 99).collect())
    ends = {r.key: (r.lo, r.hi) for r in S.rebase_extent(two).collect()}
    assert ends["Series 1"][1] == pytest.approx(18.95 / 0.05) and ends[None][1] == ends["Series 1"][1]


def test_spark_points(spark):
    df = make(spark, [("s", 0, [(1, 100), (2, 101), (3, 99), (4, 56), (5, 87)])])
    r = S.spark_points(S.point_index(df)).first()
    assert (r.min_x, r.max_x, r.last_x, r.last_y) == (4, 2, 5, 87.0)
    flat = S.spark_points(S.point_index(make(spark, [("s", 0, [(1, 7), (2, 7), (3, 7)])]))).first()
    assert (flat.min_x, flat.max_x) == (1, 3)


def test_selection(spark, two):
    assert {r.key for r in S.select_series(two, ["Series 1"]).collect()} == {"Series 2"}
    assert S.select_series(two, ["Series 1", "Series 2"]).count() == 8
    on = two.withColumn("enabled", F.lit(True))
    one = S.solo(on, "Series 1", toggle=True)
    assert {(r.key, r.enabled) for r in one.collect()} == {("Series 1", True), ("Series 2", False)}
    assert all(r.enabled for r in S.solo(one, "Series 1", toggle=True).collect())
    gap = make(spark, [("s", 0, [(i, None if i % 5 == 0 else i) for i in range(12)])])
    pieces = {r.x: r.segment for r in S.segments(gap).collect()}
    assert len(pieces) == 9 and len({pieces[i] for i in (1, 2, 3, 4)}) == 1 and pieces[4] != pieces[6]
    long = make(spark, [("s", 0, [(i, i) for i in range(25)])])
    assert sorted(r.x for r in S.stride(long, 10).collect()) == list(range(0, 25, 3))
    assert sorted(r.x for r in S.tail(long, 7).collect()) == list(range(18, 25))


def test_extent(spark):
    df = make(spark, [("s", 0, [(4, 0), (4, 5)])])
    r = S.extent(df, ["chart"], ["x", "y"], {"y": [9]}, log="y").first()
    assert (r.x_lo, r.x_hi, r.y_lo, r.y_hi) == (3.96, 4.04, 0.5, 9.0)
    zero = S.extent(make(spark, [("s", 0, [(0, 1)])]), ["chart"], ["x"]).first()
    assert (zero.x_lo, zero.x_hi) == (-1.0, 1.0)


# fixed values: worked nearest-index cases
FIB = [0, 1, 1, 2, 3, 5, 8, 13, 21, 34]
SIX = [0, 1, 2, 3, 4, 5]
CASES = [
    (FIB, 7, 6), (SIX, 3, 3), (SIX, 0, 0), (SIX, 5, 5), (SIX, -4, 0), (SIX, 10, 5), (SIX, 0.34, 0), (SIX, 1.50001, 2),
    (FIB, 8, 6), (FIB, 15, 7), (FIB, 20, 8), ([0], 0, 0), ([0], -4, 0), ([0], 1, 0),
]


@pytest.mark.parametrize("hot", [None, 2])
def test_nearest_worked_cases(spark, hot):
    points = spark.createDataFrame(
        [(n, i, float(x), 1.0) for n, (xs, _, _) in enumerate(CASES) for i, x in enumerate(xs)], "k int, idx int, x double, y double"
    )
    probes = spark.createDataFrame([(n, n, float(p)) for n, (_, p, _) in enumerate(CASES)] + [(99, 99, 4.0)], "k int, probe_id int, at double")
    got = {r.probe_id: r.idx for r in lookup.nearest(points, probes, ["k"], hot_rows=hot).collect()}
    assert got == {n: want for n, (_, _, want) in enumerate(CASES)}


def test_nearest_value_rules(spark):
    values = spark.createDataFrame([(1, 0, 5.0), (1, 1, 7.0), (1, 2, 5.0), (1, 3, None)], "k int, idx int, value double")
    probes = spark.createDataFrame([(1, 0, 6.0), (1, 1, 4.9), (1, 2, 20.0)], "k int, probe_id int, at double")
    got = {r.probe_id: r.idx for r in lookup.nearest_within(values, probes, ["k"], 2.0).collect()}
    assert got == {0: 2, 1: 2, 2: None}
    first = lookup.closest_index(values.where("value IS NOT NULL").withColumnRenamed("value", "x"), probes, ["k"])
    assert {r.probe_id: r.idx for r in first.collect()} == {0: 0, 1: 0, 2: 1}


def test_band_and_cross_section(spark, two):
    st = S.stack(two.where("x >= 0"), "zero")
    probes = spark.createDataFrame([(0, "c", 2, 10.0), (1, "c", 2, 18.0), (2, "c", 2, 30.0), (3, "c", 2, 33.0), (4, "c", 2, -20.0)], "probe_id int, chart string, x long, at double")
    assert {r.probe_id: r.series_idx for r in lookup.band_at(st, probes).collect()} == {0: 0, 1: 0, 2: 1, 3: None, 4: 1}
    idx = S.point_index(two)
    at = spark.createDataFrame([("c", 0, 1.2), ("c", 1, 9.0)], "chart string, probe_id int, at double")
    got = {(r.probe_id, r.key): r.value for r in lookup.cross_section(idx, at).collect()}
    assert got == {(0, "Series 1"): 12, (0, "Series 2"): 13, (0, "TOTAL"): 25, (1, "Series 1"): 18, (1, "Series 2"): 14, (1, "TOTAL"): 32}
    assert lookup.cross_section(idx, at, expand=True).where("total").count() == 0
    assert lookup.cross_section(idx.withColumn("y", F.lit(None).cast("double")), at).where("total").count() == 0
