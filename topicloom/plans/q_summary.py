"""Queries: summaries, wide records, scalar functions, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import error_interval, fmt_date, fmt_number, nan_to_zero, slice_label, value_or_na
from ..operators import filters, shares, sketches, summary
from ..operators import series as S
from ..session import fresh_path, materialise
from ..streaming import STORE, latest_bins, run_available, stream_tail, stream_topic_weights
from . import corpus as c
from .corpus import with_
from .registry import query, rnd, rounded, table


# ---------------------------------------------------------------- boxes, bars, lines
_BOX = """
    WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3
               FROM events GROUP BY event_type),
    f AS (SELECT e.event_type, e.value, q1, q2, q3, value BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 AS inside
          FROM events e JOIN q USING (event_type))"""


@query("a11_box_summary", _BOX + """
    SELECT event_type, round(q1, 6) + 0.0 AS q1, round(q2, 6) + 0.0 AS q2, round(q3, 6) + 0.0 AS q3, min(value) FILTER (inside) AS whisker_low,
           max(value) FILTER (inside) AS whisker_high, count(*) FILTER (NOT inside) AS n_outliers FROM f GROUP BY ALL""")
def a_box(spark, sf):
    return rounded(summary.box_summary(table(spark, sf, "events"), ["event_type"], "value"), ["q1", "q2", "q3"])


@query("a11_box_summary_split", """
    SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) + 0.0 AS q1, round(quantile_cont(l_extendedprice, 0.5), 6) + 0.0 AS q2,
           round(quantile_cont(l_extendedprice, 0.75), 6) + 0.0 AS q3, count(*) AS n FROM lineitem GROUP BY l_returnflag""")
def a_quartiles(spark, sf):
    # a limit far below the size of a group, so that groups are cut into blocks at every scale
    q = summary.quartiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", hot_rows=5000)
    return rounded(q, ["q1", "q2", "q3"])


@query("a11_box_outliers", _BOX + "SELECT event_type, value AS outlier, count(*) AS copies FROM f WHERE NOT inside GROUP BY ALL")
def a_outliers(spark, sf):
    return summary.box_outliers(table(spark, sf, "events"), ["event_type"], "value")


@query("a10_box_extent", "SELECT 'all' AS chart, min(value) AS lo, max(value) AS hi FROM events")
def a_box_extent(spark, sf):
    e = table(spark, sf, "events").withColumn("chart", F.lit("all"))
    boxes = summary.box_summary(e, ["chart", "event_type"], "value")
    outliers = summary.box_outliers(e, ["chart", "event_type"], "value")
    return summary.box_extent(boxes, outliers, ["chart"])


@query("a11_sketched_quartiles", f"""
    SELECT event_type, p AS probability, count(*) AS n, TRUE AS within FROM events, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) v(p)
    WHERE epoch_us(ts) // 86400000000 BETWEEN {c.DAY0 + 3} AND {c.DAY0 + 20} GROUP BY ALL""")
def a_sketched(spark, sf):
    """Quartiles from merged daily sketches; ``within`` tells if the exact rank of each is as near as stated."""
    days = materialise(sketches.quantile_sketches(table(spark, sf, "events"), ["event_type"], c.day("ts"), "value"), "day-sketches")
    lo, hi = c.DAY0 + 3, c.DAY0 + 20
    found = sketches.sketched_quantiles(days, ["event_type"], [0.25, 0.5, 0.75], lo, hi)
    rows = table(spark, sf, "events").where(c.day("ts").between(lo, hi)).select(F.col("event_type").alias("kind"), F.col("value").alias("v"))
    met = found.join(rows, F.col("event_type") == F.col("kind")).groupBy("event_type", "probability", "n", "value")
    ranks = met.agg(F.sum((F.col("v") < F.col("value")).cast("int")).alias("less"), F.sum((F.col("v") <= F.col("value")).cast("int")).alias("upto"))
    off = sketches.RANK_ERROR * F.col("n") + 1
    near = (F.col("less") <= F.col("probability") * F.col("n") + off) & (F.col("upto") >= F.col("probability") * F.col("n") - off)
    return ranks.select("event_type", "probability", "n", near.alias("within"))


@query("a05_sketched_distinct", f"""
    SELECT event_type, count(DISTINCT user_id) AS exact, TRUE AS within FROM events
    WHERE epoch_us(ts) // 86400000000 BETWEEN {c.DAY0 + 3} AND {c.DAY0 + 20} GROUP BY event_type""")
def a_sketched_distinct(spark, sf):
    """Distinct users from united daily sketches, beside the exact number."""
    lo, hi = c.DAY0 + 3, c.DAY0 + 20
    events = table(spark, sf, "events")
    days = materialise(sketches.distinct_sketches(events, ["event_type"], c.day("ts"), "user_id"), "day-sketches")
    found = sketches.sketched_distinct(days, ["event_type"], lo, hi)
    exact = events.where(c.day("ts").between(lo, hi)).groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"))
    near = F.abs(F.col("distinct_count") - F.col("exact")) <= F.lit(sketches.COUNT_ERROR) * F.col("exact") + 1
    return found.join(exact, "event_type").select("event_type", "exact", near.alias("within"))


@query("a12_ohlc", """
    SELECT event_type, epoch_us(ts) // 86400000000 AS bucket, arg_min(value, struct_pack(t := ts, i := event_id)) AS open, max(value) AS high, min(value) AS low,
           arg_max(value, struct_pack(t := ts, i := event_id)) AS close FROM events GROUP BY ALL""")
def a_ohlc(spark, sf):
    return summary.ohlc(table(spark, sf, "events"), ["event_type"], c.day("ts"), ["ts", "event_id"], "value")


@query("a12_ohlc_items", """
    SELECT l_returnflag, epoch_us(l_shipdate) // 86400000000 AS bucket,
           arg_min(l_extendedprice, struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_suppkey, e := l_extendedprice)) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
           arg_max(l_extendedprice, struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_suppkey, e := l_extendedprice)) AS close FROM lineitem GROUP BY ALL""")
def a_ohlc_items(spark, sf):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return summary.ohlc(table(spark, sf, "lineitem"), ["l_returnflag"], c.day("l_shipdate"), order, "l_extendedprice")


@query("a08_bar_extent", "SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type")
def a_bar_extent(spark, sf):
    return summary.ohlc_extent(a_ohlc(spark, sf), ["event_type"])


@query("a13_reg_line", with_("ev", """
    , l AS (SELECT key, regr_slope(y, x - 19700) AS slope, regr_intercept(y, x - 19700) AS intercept FROM ev GROUP BY key),
    e AS (SELECT min(x - 19700) AS a, max(x - 19700) AS b FROM ev)
    SELECT key, round(slope, 4) + 0.0 AS slope, round(intercept, 4) + 0.0 AS intercept, round(a * slope + intercept, 4) + 0.0 AS y_lo,
           round(b * slope + intercept, 4) + 0.0 AS y_hi FROM l, e"""))
def a_reg(spark, sf):
    s = c.event_series(spark, sf).withColumn("x", F.col("x") - 19700)
    return rounded(summary.reg_line(s).drop("chart"), ["slope", "intercept", "y_lo", "y_hi"], 4)


# ---------------------------------------------------------------- wide records
def _wide(spark, sf):
    """Parts with one numeric column missing in places and one that is text in places."""
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("name"),
        F.when(F.col("p_size") > 5, F.col("p_size")).alias("size"),
        F.when(F.col("p_type") == "ECONOMY", F.lit("n/a")).otherwise(F.col("p_retailprice").cast("string")).alias("price"),
        F.lit(None).cast("double").alias("empty"),
        F.lit(7).alias("flat"),
    )


_WIDE = """WITH w AS (SELECT CAST(p_partkey AS VARCHAR) AS name, CASE WHEN p_size > 5 THEN p_size END AS size,
    CASE WHEN p_type = 'ECONOMY' THEN NULL ELSE p_retailprice END AS price, p_type FROM part)"""


@query("a09_extents_nd", _WIDE + """
    SELECT 'size' AS dim, min(size)::DOUBLE AS lo, max(size)::DOUBLE AS hi FROM w UNION ALL SELECT 'price', min(price), max(price) FROM w
    UNION ALL SELECT 'empty', -1.0, 1.0 UNION ALL SELECT 'flat', 6.0, 8.0""")
def a_extents(spark, sf):
    return filters.extents_nd(_wide(spark, sf), ["size", "price", "empty", "flat"])


@query("p12_brush_nd", _WIDE + """
    SELECT name FROM w WHERE (CASE WHEN size IS NULL THEN 6.0 = (SELECT min(size) FROM w) ELSE size BETWEEN 6.0 AND 30.0 END)
      AND (CASE WHEN price IS NULL THEN FALSE ELSE price BETWEEN 950.0 AND 1500.0 END)""")
def p_brush_nd(spark, sf):
    return filters.brush_nd(_wide(spark, sf), {"size": (6, 30), "price": (950, 1500)}).select("name")


@query("p18_pack", _WIDE + """
    SELECT name AS key, CAST(size AS VARCHAR) AS size, CASE WHEN p_type = 'ECONOMY' THEN 'n/a' ELSE 'number' END AS price FROM w""")
def p_pack(spark, sf):
    packed = filters.pack(_wide(spark, sf), "name", ["size", "price"])
    price = F.when(F.col("values")["price"] == "n/a", "n/a").otherwise("number")
    return packed.select("key", F.col("values")["size"].alias("size"), price.alias("price"))


@query("o06_co_sort", """
    WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, unnest([l_quantity, l_extendedprice, l_tax * 100]) AS value,
               unnest(['quantity', 'price', 'tax']) AS label, unnest([0, 1, 2]) AS i FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list(label ORDER BY value DESC, i), ',') AS labels, max(value) AS largest, min(value) AS smallest
    FROM v GROUP BY l_orderkey, l_linenumber, l_partkey HAVING count(*) = 3""")
def o_co_sort(spark, sf):
    li = table(spark, sf, "lineitem")
    once = li.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(
        F.count(F.lit(1)).alias("n"), *[F.max(x).alias(x) for x in ("l_quantity", "l_extendedprice", "l_tax")]
    ).where(F.col("n") == 1)
    values = F.array("l_quantity", "l_extendedprice", F.col("l_tax") * 100)
    sorted_ = filters.co_sort(values, F.array(F.lit("quantity"), F.lit("price"), F.lit("tax")))
    marks = filters.range_marks(values)
    return once.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.array_join(F.transform(sorted_, lambda r: r["label"]), ",").alias("labels"),
        marks["max"].alias("largest"), marks["min"].alias("smallest"),
    )


@query("o07_order_dims", """
    SELECT n_name AS key, n_nationkey AS position FROM nation WHERE n_regionkey <> 2 ORDER BY n_nationkey""")
def o_dims(spark, sf):
    dims = table(spark, sf, "nation").select(
        F.col("n_name").alias("key"), F.col("n_nationkey").alias("position"), (F.col("n_regionkey") == 2).alias("disabled")
    )
    return filters.order_dims(dims).select("key", "position")


# ---------------------------------------------------------------- scalar functions
_SLICE = """
    WITH s AS (SELECT o_orderpriority AS key, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS v FROM orders GROUP BY ALL),
    h AS (SELECT key, v, CASE WHEN key = '5-LOW' THEN 0 ELSE v END AS w FROM s),
    t AS (SELECT key, v, w / sum(w) OVER () AS share FROM h)"""


@query("f11_slice_share", _SLICE + """
    SELECT key, round(share, 9) + 0.0 AS share, CASE WHEN share < 0.02 THEN '' ELSE key END AS label,
           CASE WHEN share < 0.02 THEN '' ELSE CAST(round(share * 100) AS BIGINT) || '%' END AS percent FROM t""")
def f_slice(spark, sf):
    slices = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("key")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    slices = slices.withColumns({"chart": F.lit("pie"), "off": F.col("key") == "5-LOW"})
    s = shares.slice_share(slices, ["chart"], "v", "off")
    args = (F.col("key"), F.col("v"), F.col("share"))
    return s.select("key", rnd("share", 9).alias("share"), slice_label("key", *args).alias("label"), slice_label("percent", *args).alias("percent"))


@query("f11_slice_bounds", _SLICE + """
    SELECT key, round(coalesce(sum(share) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 9) + 0.0 AS start,
           round(sum(share) OVER (ORDER BY key ROWS UNBOUNDED PRECEDING), 9) + 0.0 AS "end" FROM t""")
def f_bounds(spark, sf):
    slices = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("key")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    slices = materialise(slices.withColumns({"chart": F.lit("pie"), "off": F.col("key") == "5-LOW"}), "slices")
    return rounded(shares.slice_bounds(slices, ["chart"], ["key"], "v", "off").select("key", "start", "end"), ["start", "end"], 9)


@query("f12_nan_to_zero", """
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.0 WHEN 3 THEN 0.0 ELSE value END AS v FROM events""")
def f_nan(spark, sf):
    kind = F.col("event_id") % 5
    raw = (
        F.when(kind == 0, F.lit(float("nan"))).when(kind == 1, F.lit(float("inf"))).when(kind == 2, F.lit(float("-inf")))
        .when(kind == 4, F.col("value"))
    )
    return table(spark, sf, "events").select("event_id", nan_to_zero(raw).alias("v"))


@query("f13_value_or_na", with_("ev gappy", """SELECT key, x, coalesce(format('{:,.2f}', y), 'N/A') AS text FROM gappy"""))
def f_na(spark, sf):
    return c.gappy_series(spark, sf).select("key", "x", value_or_na(F.col("y")).alias("text"))


@query("f14_formats", """
    SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS price, strftime(o_orderdate, '%m/%d/%Y') AS day FROM orders""")
def f_formats(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", fmt_number(F.col("o_totalprice")).alias("price"), fmt_date(F.col("o_orderdate")).alias("day"))


@query("f15_error_interval", "SELECT event_id, -abs(value - 40) AS lo, abs(value - 40) AS hi FROM events")
def f_error(spark, sf):
    e = error_interval(F.col("value") - 40)
    return table(spark, sf, "events").select("event_id", e[0].alias("lo"), e[1].alias("hi"))


# ---------------------------------------------------------------- streams
def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("t01_stream_topic_series", with_("doc_topic dtt", f"""
    SELECT t // 86400 AS day, CAST(i AS INTEGER) AS topic, round(sum(weights[i + 1]), 6) + 0.0 AS weight, count(*) AS count
    FROM dtt, range({c.TOPICS}) r(i) GROUP BY ALL"""))
def t_series(spark, sf):
    out = fresh_path(spark, "stream-bins")
    messages = _event_stream(spark, sf).select(F.col("event_id").alias("message_id"), "ts", c.thread(spark, sf, F.col("event_id")).alias("doc_id"))
    run_available(stream_topic_weights(messages, c.doc_topic(spark, sf), c.TOPICS, "1 day", "40 days"), out, fresh_path(spark, "stream"))
    latest = latest_bins(spark.read.option("basePath", out).parquet(out), ["bin_start"], "batch")
    long = latest.select(c.day("bin_start").alias("day"), F.posexplode("weights").alias("topic", "weight"), "count")
    return rounded(long, ["weight"], 6)


@query("t02_stream_tail", """
    SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    WHERE rn <= 70""")
def t_tail(spark, sf):
    # the provider is looked up when a stream starts, and must be the one with list state
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    out = fresh_path(spark, "stream-tail")
    points = _event_stream(spark, sf).select("event_type", "ts", "event_id", "value")
    run_available(stream_tail(points, ["event_type"], ["ts", "event_id"], 70), out, fresh_path(spark, "stream"))
    return latest_bins(spark.read.option("basePath", out).parquet(out), ["event_type"], "batch").select("event_type", "event_id", "value")
