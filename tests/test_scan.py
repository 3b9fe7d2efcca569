import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.operators import graph, scan, shares
from topicloom.operators.scan import Running, ordered_scan, row_number


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    n = 3000
    x = np.where(rng.random(n) < 0.4, 5.0, np.exp(rng.normal(0, 4, n)))
    x[:5] = [np.nan, np.inf, -np.inf, 1e300, -1e300]
    key = np.where(rng.random(n) < 0.5, "hot", rng.integers(0, 30, n).astype(str))
    data = [(str(k), float(v), int(i), int(u)) for k, v, i, u in zip(key, x, rng.permutation(n), rng.integers(0, 9, n))]
    data += [("hot", None, n + i, 1) for i in range(3)]
    path = str(tmp_path_factory.mktemp("scan") / "rows")
    spark.createDataFrame(data, "k string, x double, id long, v long").write.parquet(path)
    return spark.read.parquet(path)


def frames():
    return {
        "upto": Running("sum", F.lit(1), "upto"), "before": Running("max", F.struct("x", "id"), "before"),
        "from": Running("sum", F.lit(1), "from"), "after": Running("min", F.struct("x", "id"), "after"),
    }


@pytest.mark.parametrize("limit", [20, 700])
def test_split_groups_give_the_plain_window(rows, limit):
    split = ordered_scan(rows, ["k"], ["x", "id"], frames(), hot_rows=limit)
    plain = ordered_scan(rows, ["k"], ["x", "id"], frames(), hot_rows=None)
    assert sorted(map(repr, split.collect())) == sorted(map(repr, plain.collect()))


def test_whole_table_by_text(rows):
    named = rows.withColumn("name", F.concat(F.lit("wörd"), F.col("id").cast("string")))
    got = row_number(named, [], [-F.col("v"), "name"], hot_rows=40).select("id", "rn").collect()
    want = row_number(named, [], [-F.col("v"), "name"], hot_rows=None).select("id", "rn").collect()
    assert sorted(got) == sorted(want) and sorted(r.rn for r in got) == list(range(1, len(got) + 1))


def test_result_does_not_depend_on_partitions(rows):
    a = ordered_scan(rows.repartition(7), ["k"], ["x", "id"], frames(), hot_rows=50).collect()
    b = ordered_scan(rows.coalesce(1), ["k"], ["x", "id"], frames(), hot_rows=50).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_no_task_gets_a_hot_group(rows):
    scanned = ordered_scan(rows, ["k"], ["x", "id"], {"n": Running("sum", F.lit(1))}, hot_rows=100)
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "__block" in plan and "ExistingRDD" not in plan


FIRST = {
    "long shared prefix": lambda i: F.concat(F.lit("file:/"), F.chr(97 + i % 2)),
    "null beside one value": lambda i: F.when(i % 2 == 0, 5),
    "infinity beside one value": lambda i: F.when(i % 2 == 0, 5.0).otherwise(float("inf")),
    "beyond 2^53": lambda i: F.lit(2**60) + i % 3,
    "timestamp": lambda i: F.timestamp_seconds(i % 7),
    "boolean": lambda i: i % 2 == 0,
    "long text": lambda i: F.concat(F.lit("http://example.org/" + "a" * 40), (i % 11).cast("string")),
}


@pytest.mark.parametrize("kind", sorted(FIRST))
def test_first_order_column_of_any_type(spark, kind):
    df = spark.range(1000).select("id", FIRST[kind](F.col("id")).alias("first"), ((F.col("id") * 7919) % 1000).alias("second"))
    got = row_number(df, [], ["first", "second"], hot_rows=100)
    want = row_number(df, [], ["first", "second"], hot_rows=None)
    assert sorted(map(tuple, got.select("id", "rn").collect())) == sorted(map(tuple, want.select("id", "rn").collect()))


def test_null_weights(spark):
    df = spark.range(600).select(F.lit("g").alias("g"), "id", F.when(F.col("id") % 2 == 0, 1.0).alias("w"))
    cut = [shares.mass_cut(df, ["g"], "id", "w", 0.5, hot_rows=h).select("id", "rank").collect() for h in (60, None)]
    assert sorted(cut[0]) == sorted(cut[1]) and min(r["rank"] for r in cut[0]) == 1 and len(cut[0]) == 149
    ranks = [shares.rank_by_weight(df, ["g"], "id", "w", hot_rows=h).select("id", "rank").collect() for h in (60, None)]
    assert sorted(ranks[0]) == sorted(ranks[1])
    edges = df.select(F.lit(0).alias("i"), F.col("id").alias("j"), F.col("w").alias("sim"))
    both = [graph.rank_edges(edges, hot_rows=h).select("j", "rank").collect() for h in (60, None)]
    assert sorted(both[0]) == sorted(both[1])


def test_ranges_do_not_grow_with_the_rows(rows, monkeypatch):
    """Each range puts sampled rows and a task's result on the driver."""
    monkeypatch.setattr(scan, "MOST_RANGES", 6)
    keyed = rows.withColumns({"__v_n": F.lit(1), "__o0": F.col("x"), "__o1": F.col("id")})
    blocks = scan._blocks(keyed, ["k"], ["__o0", "__o1"], {"n": Running("sum", F.lit(1))}, 10)
    assert 1 < blocks.select(scan.BLOCK).distinct().count() <= 6
    split = ordered_scan(rows, ["k"], ["x", "id"], frames(), hot_rows=10)
    plain = ordered_scan(rows, ["k"], ["x", "id"], frames(), hot_rows=None)
    assert sorted(map(repr, split.collect())) == sorted(map(repr, plain.collect()))
