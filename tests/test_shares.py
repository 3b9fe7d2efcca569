import pytest
from pyspark.sql import functions as F

from topicloom.operators import shares

# fixed values: a 15 x 5 matrix of topics by clusters, 0.13333 where topic div 3 = cluster
HIGH, LOW = 0.13333, 0.05


@pytest.fixture(scope="module")
def clusters(spark):
    rows = [(c, t, HIGH if t // 3 == c else LOW) for t in range(15) for c in range(5)]
    return spark.createDataFrame(rows, "cluster int, topic int, weight double")


@pytest.mark.parametrize("hot", [None, 4])
def test_stored_topic_order(clusters, hot):
    cut = shares.mass_cut(clusters, ["cluster"], "topic", "weight", 0.40, hot_rows=hot).orderBy("cluster", "rank").collect()
    got = {c: [r.topic for r in cut if r.cluster == c] for c in range(5)}
    assert got == {0: [2, 1, 0], 1: [5, 4, 3], 2: [8, 7, 6], 3: [11, 10, 9], 4: [14, 13, 12]}


def test_single_heavy_item_gives_nothing(spark):
    df = spark.createDataFrame([(1, 0, 0.8), (1, 1, 0.2), (2, 0, 0.0)], "g int, id int, w double")
    assert shares.mass_cut(df, ["g"], "id", "w", 0.4).count() == 0


def test_cut_grows_with_p_and_split_matches(spark):
    df = spark.range(2000).select(
        (F.col("id") % 3).alias("g"), "id", (F.pmod(F.xxhash64("id"), F.lit(50)) + 1).cast("double").alias("w")
    )
    sizes = []
    for p in (0.1, 0.3, 0.6):
        a = shares.mass_cut(df, ["g"], "id", "w", p, hot_rows=60).select("g", "id", "rank", F.round("cum", 9)).collect()
        b = shares.mass_cut(df, ["g"], "id", "w", p, hot_rows=None).select("g", "id", "rank", F.round("cum", 9)).collect()
        assert sorted(a) == sorted(b)
        sizes.append(len(a))
    assert sizes == sorted(sizes) and sizes[0] > 0


def test_negative_weights_follow_the_running_sum(spark):
    df = spark.createDataFrame([(1, 0, 6.0), (1, 1, 5.0), (1, 2, -4.0), (1, 3, 3.0)], "g int, id int, w double")
    for hot in (None, 1):
        got = shares.mass_cut(df, ["g"], "id", "w", 1.05, hot_rows=hot)
        assert sorted(r.id for r in got.collect()) == [0, 2]


def test_shares_add_to_one(spark, clusters):
    s = shares.share(clusters, ["cluster"], "weight").groupBy("cluster").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in s)
    w = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.6])], "id int, w array<double>")
    assert [r.id for r in shares.weight_check(w, "id", "w").collect()] == [2]


def test_hidden_slices(spark):
    rows = [("p", "America", 100.0, False), ("p", "Europe", 200.0, True), ("p", "Asia", 50.0, False), ("p", "Africa", 70.0, False)]
    df = spark.createDataFrame(rows, "c string, k string, v double, off boolean")
    got = {r.k: r.share for r in shares.slice_share(df, ["c"], "v", "off").collect()}
    assert got["Europe"] == 0 and abs(got["America"] - 100 / 220) < 1e-12
