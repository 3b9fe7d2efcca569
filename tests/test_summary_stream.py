import datetime as dt

from pyspark.sql import functions as F

from topicloom.functions import instant
from topicloom.operators import filters, summary
from topicloom.operators.series import tail
from topicloom.streaming import late_rows, latest_bins, record_late_rows, run_available, stream_tail, stream_topic_weights


def test_bullet_order(spark):
    df = spark.sql("SELECT array(10.0D, 30.0D, 20.0D, 30.0D) AS v, array('a', 'b', 'c', 'd') AS l")
    row = df.select(filters.co_sort(F.col("v"), F.col("l")).alias("s"), *[c.alias(n) for n, c in filters.range_marks(F.col("v")).items()]).first()
    assert [(r.value, r.label) for r in row.s] == [(30, "b"), (30, "d"), (20, "c"), (10, "a")]
    assert (row["max"], row.second, row["min"]) == (30, 30, 10)


def test_boxes(spark):
    df = spark.createDataFrame([("g", float(v)) for v in [1, 2, 3, 4, 5, 6, 7, 8, 9, 100, -80]] + [("one", 5.0), ("one", None)], "g string, v double")
    for hot in (None, 3):
        box = {r.g: r for r in summary.box_summary(df, ["g"], "v", hot).collect()}
        assert (box["g"].q1, box["g"].q2, box["g"].q3, box["g"].whisker_low, box["g"].whisker_high, box["g"].n_outliers) == (2.5, 5.0, 7.5, 1.0, 9.0, 2)
        assert box["one"].q1 == box["one"].q3 == 5.0
    out = summary.box_outliers(df, ["g"], "v")
    assert sorted((r.outlier, r.copies) for r in out.collect()) == [(-80.0, 1), (100.0, 1)]
    given = spark.sql("SELECT 'c' AS chart, 120.0D AS q1, 150.0D AS q2, 200.0D AS q3, 115.0D AS whisker_low, 210.0D AS whisker_high, array(50.0D, 100.0D, 225.0D) AS outliers")
    r = summary.box_extent_nested(given, ["chart"]).first()
    assert (r.lo, r.hi) == (50.0, 225.0)


def test_brush_of_records(spark):
    df = spark.createDataFrame([("a", "1", 5.0), ("b", "x", 6.0), ("c", "3", None), ("d", "9", 7.0)], "name string, p string, q double")
    ext = {r.dim: (r.lo, r.hi) for r in filters.extents_nd(df, ["p", "q"]).collect()}
    assert ext == {"p": (1.0, 9.0), "q": (5.0, 7.0)}
    assert sorted(r.name for r in filters.brush_nd(df, {"p": (1, 4)}).collect()) == ["a", "b", "c"]
    assert sorted(r.name for r in filters.brush_nd(df, {"p": (2, 9)}).collect()) == ["c", "d"]
    assert sorted(r.name for r in filters.brush_nd(df, {"p": (1, 9), "q": (6, 7)}).collect()) == ["b", "d"]


def test_array_predicates(spark):
    df = spark.createDataFrame([(1, ["kevin", "al"]), (2, ["bob"]), (3, [])], "id int, to array<string>")
    assert [r.id for r in filters.any_starts_with(df, "to", "kev").collect()] == [1]
    facts = {r.id: (r["first"], r.size, r.has_member) for r in filters.array_facts(df, "id", "to", "bob").collect()}
    assert facts == {1: ("kevin", 2, False), 2: ("bob", 1, True), 3: (None, 0, False)}


def day(n, hour=1):
    return dt.datetime(2024, 1, n, hour)


def message(i, when, doc=0):
    return i, doc, when


def test_weights_on_a_stream_account_for_late_rows(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = "message_id long, doc_id long, ts timestamp_ntz"
    weights = spark.createDataFrame([(d, [float(d + i) for i in range(64)]) for d in range(3)], "doc_id long, weights array<double>")
    batches = [
        [message(1, day(1)), message(2, day(2), 1), message(2, day(2), 1)],
        [message(3, day(10), 2), message(4, day(9), 7)],  # no weights for document 7
        [message(5, day(11))],
        [message(10 + i, day(1, 5 + i)) for i in range(7)] + [message(6, day(12), 1)],  # seven late ones of one day
    ]
    told, late = [], str(tmp_path / "late")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        q = run_available(stream_topic_weights(stream, weights, 64, "1 day", "2 days"), out, cp)
        told += [r.late for r in late_rows(q).collect()]
        record_late_rows(q, late)
    assert sum(told) == 7
    assert sorted(r.late for r in spark.read.parquet(late).collect())[-1] == 7
    found = latest_bins(spark.read.option("basePath", out).parquet(out), ["bin_start"], "batch")
    got = {r.bin_start.day: (r.weights, r["count"]) for r in found.collect()}
    on_time = spark.createDataFrame([r for b in batches for r in b if not 10 <= r[0] <= 16], schema)
    table = stream_topic_weights(on_time, weights, 64, "1 day", "2 days")
    assert got == {r.bin_start.day: (r.weights, r["count"]) for r in table.collect()}
    assert got[2] == ([1.0 + i for i in range(64)], 1) and set(got) == {1, 2, 10, 11, 12}
    assert on_time.select(instant(on_time, "ts")).schema[0].dataType.typeName() == "timestamp"


def tails(spark, out):
    found = latest_bins(spark.read.option("basePath", out).parquet(out), ["key"], "batch")
    rows = {}
    for r in found.orderBy("key", "pos").collect():
        rows.setdefault(r.key, []).append(r.x)
    return rows


def test_last_points_survive_a_restart(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = "key string, x long, at timestamp, y double"
    for i in range(3):
        rows = [("a", 10 * i + j, day(1 + i, j), float(j)) for j in range(4)] + [("b", 5 - i, None, None), (None, i, day(1), 1.0)]
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(src)
        run_available(stream_tail(stream, ["key"], ["x"], 3), out, cp)  # a new query each time, on the same state
    whole = spark.read.schema(schema).parquet(src)
    want = {}
    for r in tail(whole, 3, ["key"], ["x"]).orderBy("key", "x").collect():
        want.setdefault(r.key, []).append(r.x)
    assert tails(spark, out) == want == {"a": [21, 22, 23], "b": [3, 4, 5], None: [0, 1, 2]}


def test_idle_series_are_forgotten(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = "key string, x long, at timestamp"
    batches = [[("a", 1, day(1)), ("a", 2, day(1, 2)), ("c", 1, day(7))], [("b", 1, day(9))], [("b", 2, day(10))], [("a", 3, day(11)), ("c", 2, day(11))]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        run_available(stream_tail(stream, ["key"], ["x"], 3, idle=("at", "5 days")), out, cp)
    assert tails(spark, out) == {"a": [3], "b": [1, 2], "c": [1, 2]}
