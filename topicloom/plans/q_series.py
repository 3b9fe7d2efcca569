"""Queries: series, stacks, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, lookup, series as S
from ..session import materialise
from . import corpus as c
from .corpus import DAY0, with_
from .registry import query, rnd, rounded, table

COLS = ["key", "x", "y"]


def ev(spark, sf):
    """Event series, stored: the operators below read it several times."""
    return materialise(c.event_series(spark, sf), "series")


def items(spark, sf):
    return materialise(c.item_series(spark, sf), "series")


def evi(spark, sf):
    return materialise(S.point_index(ev(spark, sf)), "indexed")


def signed(spark, sf):
    value = F.sum(F.col("value") - 50)
    return materialise(c.event_series(spark, sf, value), "signed")


_SIGNED = """
    , sg AS (SELECT event_type AS key, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS INTEGER) AS series_idx,
             epoch_us(ts) // 86400000000 AS x, round(sum(value - 50), 2) AS y FROM events GROUP BY ALL)"""


# ---------------------------------------------------------------- selection
@query("p11_brush", with_("ev", f"SELECT key, x, y FROM ev WHERE x >= {DAY0 + 5} AND x <= {DAY0 + 12}"))
def p_brush(spark, sf):
    return S.brush(c.event_series(spark, sf), DAY0 + 5, DAY0 + 12).select(*COLS)


@query("p13_select_series", with_("ev", "SELECT key, x, y FROM ev WHERE key NOT IN ('click', 'error')"))
def p_select(spark, sf):
    return S.select_series(c.event_series(spark, sf), ["click", "error"]).select(*COLS)


@query("p13_select_all_off", with_("ev li", """
    SELECT chart, key, x, y FROM ev WHERE key <> 'click' UNION ALL SELECT chart, key, x, y FROM li"""))
def p_select_all(spark, sf):
    both = S.merge_points(c.event_series(spark, sf), c.item_series(spark, sf))
    return S.select_series(both, ["A", "N", "R", "click"]).select("chart", *COLS)


@query("p13_solo", with_("ev", "SELECT key, x, key = 'view' AS enabled FROM ev"))
def p_solo(spark, sf):
    return S.solo(c.event_series(spark, sf).withColumn("enabled", F.lit(True)), "view", toggle=True).select("key", "x", "enabled")


@query("p14_split", with_("ev", "SELECT key, x, y FROM ev WHERE series_idx < 3 AND series_idx % 2 = 0"))
def p_split(spark, sf):
    typed = c.event_series(spark, sf).withColumns({
        "type": F.when(F.col("series_idx") < 3, "line").otherwise("bar"), "axis": (F.col("series_idx") % 2 + 1).cast("int"),
    })
    return S.split_series(typed, "line", 1).select(*COLS)


@query("p15_segments", with_("ev gappy", """
    , s AS (SELECT *, CAST(sum(CASE WHEN y IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY x) AS BIGINT) AS segment FROM gappy)
    SELECT key, x, y, segment FROM s WHERE y IS NOT NULL"""))
def p_segments(spark, sf):
    return S.segments(materialise(c.gappy_series(spark, sf), "gappy")).select(*COLS, "segment")


@query("p16_stride", with_("li", """
    , n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM li)
    SELECT key, x, y FROM n WHERE i % CAST(ceil(n / 20.0) AS BIGINT) = 0"""))
def p_stride(spark, sf):
    return S.stride(items(spark, sf), 20).select(*COLS)


@query("p17_avg_lines", with_("ev", "SELECT key, round(avg(y), 6) + 0.0 AS average FROM ev GROUP BY key HAVING avg(y) <> 0"))
def p_avg(spark, sf):
    return rounded(S.avg_lines(c.event_series(spark, sf)).select("key", "average"), ["average"])


# ---------------------------------------------------------------- windows
@query("w14_point_index", with_("ev evi", "SELECT key, x, idx FROM evi"))
def w_index(spark, sf):
    return S.point_index(ev(spark, sf)).select("key", "x", "idx")


@query("w14_point_index_events", with_("pts", "SELECT idx AS event_id, row_number() OVER (PARTITION BY key ORDER BY x, idx) - 1 AS idx FROM pts"))
def w_index_events(spark, sf):
    from ..operators.scan import row_number

    p = c.event_points(spark, sf).select("key", "x", F.col("idx").alias("event_id"))
    return row_number(p, ["key"], ["x", "event_id"], "idx", start=0).select("event_id", "idx")


@query("w14_series_index", with_("ev li", """
    SELECT chart, key, dense_rank() OVER (PARTITION BY chart ORDER BY key) - 1 AS series_idx
    FROM (SELECT DISTINCT chart, key FROM ev UNION SELECT DISTINCT chart, key FROM li)"""))
def w_series_index(spark, sf):
    return S.series_index(S.merge_points(c.event_series(spark, sf), c.item_series(spark, sf)))


_OUT = "key, x, round(dy, 6) + 0.0 AS dy, round(y0, 6) + 0.0 AS y0"
_BELOW = "coalesce(sum(dy) OVER (PARTITION BY x ORDER BY {} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


def _stack(df, *args):
    return rounded(S.stack(df, *args).select("key", "x", "dy", "y0"), ["dy", "y0"])


@query("w05_stack_zero", with_("ev", f", s AS (SELECT *, y AS dy FROM ev) , t AS (SELECT key, x, dy, {_BELOW.format('series_idx')} AS y0 FROM s) SELECT {_OUT} FROM t"))
def w_zero(spark, sf):
    return _stack(c.event_series(spark, sf), "zero")


@query("w05_stack_zero_items", with_("li", f", s AS (SELECT *, y AS dy FROM li) , t AS (SELECT key, x, dy, {_BELOW.format('series_idx')} AS y0 FROM s) SELECT {_OUT} FROM t"))
def w_zero_items(spark, sf):
    return _stack(c.item_series(spark, sf), "zero")


@query("w06_stack_expand", with_("ev", f"""
    , s AS (SELECT *, y / sum(y) OVER (PARTITION BY x) AS dy FROM ev), t AS (SELECT key, x, dy, {_BELOW.format('series_idx')} AS y0 FROM s)
    SELECT {_OUT} FROM t"""))
def w_expand(spark, sf):
    return _stack(c.event_series(spark, sf), "expand")


@query("w07_stack_percent", with_("ev", f"""
    , s AS (SELECT * FROM (SELECT *, y / sum(y) OVER (PARTITION BY x) AS dy FROM ev) WHERE key <> 'error'),
    t AS (SELECT key, x, dy, {_BELOW.format('series_idx')} AS y0 FROM s) SELECT {_OUT} FROM t"""))
def w_percent(spark, sf):
    return _stack(c.event_series(spark, sf).withColumn("enabled", F.col("key") != "error"), "percent")


@query("w08_stack_silhouette", with_("ev", f"""
    , s AS (SELECT *, y AS dy, sum(y) OVER (PARTITION BY x) AS tot FROM ev),
    t AS (SELECT key, x, dy, {_BELOW.format('series_idx')} + ((SELECT max(tot) FROM s) - tot) / 2 AS y0 FROM s) SELECT {_OUT} FROM t"""))
def w_silhouette(spark, sf):
    return _stack(c.event_series(spark, sf), "silhouette")


# the slope of the layers below a series is the difference of their prefix sums at two x
_WIGGLE = """
    , s AS (SELECT *, y AS dy, y - lag(y) OVER (PARTITION BY key ORDER BY x) AS d, x - lag(x) OVER (PARTITION BY key ORDER BY x) AS dx FROM ev),
    m AS (SELECT a.x, a.key, a.y, max(a.dx) AS dx, coalesce(sum(b.d), 0) / max(a.dx) + a.d / (2 * max(a.dx)) AS s3
          FROM s a LEFT JOIN s b ON b.x = a.x AND b.series_idx < a.series_idx GROUP BY a.x, a.key, a.y, a.d),
    p AS (SELECT x, coalesce(sum(s3 * y) / sum(y) * max(dx), 0) AS step FROM m GROUP BY x),
    o AS (SELECT x, -sum(step) OVER (ORDER BY x) AS o FROM p),
    base AS (SELECT x, o - least(0, (SELECT min(o) FROM o)) AS base FROM o)"""


@query("w09_stack_wiggle", with_("ev", _WIGGLE + f"""
    , t AS (SELECT key, x, dy, base + {_BELOW.format('series_idx')} AS y0 FROM s JOIN base USING (x)) SELECT {_OUT} FROM t"""))
def w_wiggle(spark, sf):
    return _stack(ev(spark, sf), "wiggle")


_ORDER = """
    , pk AS (SELECT series_idx, arg_max(x, struct_pack(y := y, x := -x)) AS peak, sum(y) AS w FROM ev GROUP BY series_idx),
    rk AS (SELECT *, row_number() OVER (ORDER BY peak, series_idx) AS r FROM pk),
    g AS (SELECT CAST(0 AS BIGINT) AS r, CAST(0 AS DOUBLE) AS top, CAST(0 AS DOUBLE) AS bottom, CAST(NULL AS INTEGER) AS series_idx, FALSE AS up
          UNION ALL
          SELECT rk.r, CASE WHEN g.top < g.bottom THEN g.top + w ELSE g.top END, CASE WHEN g.top < g.bottom THEN g.bottom ELSE g.bottom + w END,
                 rk.series_idx, g.top < g.bottom FROM g JOIN rk ON rk.r = g.r + 1),
    ord AS (SELECT CAST(row_number() OVER (ORDER BY up, CASE WHEN up THEN r ELSE -r END) - 1 AS INTEGER) AS pos, series_idx FROM g WHERE r > 0)"""


def _recursive(text: str) -> str:
    return text.replace("WITH", "WITH RECURSIVE", 1)


@query("w10_series_order", _recursive(with_("ev", _ORDER + "SELECT 'events' AS chart, pos, series_idx FROM ord")))
def w_order(spark, sf):
    return S.series_order(ev(spark, sf)).select("chart", "pos", "series_idx")


@query("w10_stream_stack", _recursive(with_("ev", _ORDER + """
    , eo AS (SELECT ev.* REPLACE (ord.pos AS series_idx) FROM ev JOIN ord USING (series_idx))""" + _WIGGLE.replace("FROM ev)", "FROM eo)") + f"""
    , t AS (SELECT key, x, dy, base + {_BELOW.format('series_idx')} AS y0 FROM s JOIN base USING (x)) SELECT {_OUT} FROM t""")))
def w_stream(spark, sf):
    return _stack(ev(spark, sf), "wiggle", "inside-out")


@query("w11_signed_stack", with_("ev", _SIGNED + """
    , p AS (SELECT a.key, a.x, a.y, coalesce(sum(b.y), 0) AS base FROM sg a
            LEFT JOIN sg b ON a.x = b.x AND b.series_idx < a.series_idx AND (a.y < 0) = (b.y < 0) GROUP BY a.key, a.x, a.y)
    SELECT key, x, round(least(base, base + y), 6) + 0.0 AS bar_lo, round(greatest(base, base + y), 6) + 0.0 AS bar_hi FROM p"""))
def w_signed(spark, sf):
    return rounded(S.signed_stack(signed(spark, sf)).select("key", "x", "bar_lo", "bar_hi"), ["bar_lo", "bar_hi"])


_REB = """, r AS (SELECT * REPLACE (round(y / 4000 - 1 - series_idx * 0.2, 10) AS y) FROM evi)"""


def _shares(spark, sf):
    y = F.round(F.col("y") / 4000 - 1 - F.col("series_idx") * 0.2, 10)
    return evi(spark, sf).withColumn("y", y)


@query("w12_rebase", with_("ev evi", _REB + """
    , v AS (SELECT key, y AS v FROM r WHERE idx = 3)
    SELECT key, x, v < -0.95 AS off, round(CASE WHEN v < -0.95 THEN y ELSE (y - v) / (1 + v) END, 9) + 0.0 AS display FROM r JOIN v USING (key)"""))
def w_rebase(spark, sf):
    return rounded(S.rebase(_shares(spark, sf), 3).select("key", "x", "off", "display"), ["display"], 9)


@query("a16_rebase_extent", with_("ev evi", _REB + """
    , e AS (SELECT key, greatest(min(y), -0.95) AS a, max(y) AS b FROM r GROUP BY key),
    d AS (SELECT key, (a - b) / (1 + b) AS lo, (b - a) / (1 + a) AS hi FROM e WHERE b <> -1),
    u AS (SELECT * FROM d UNION ALL SELECT NULL, min(lo), max(hi) FROM d)
    SELECT key, round(lo, 6) + 0.0 AS lo, round(hi, 6) + 0.0 AS hi FROM u"""))
def a_rebase(spark, sf):
    return rounded(S.rebase_extent(_shares(spark, sf)).select("key", "lo", "hi"), ["lo", "hi"])


@query("w13_spark_points", with_("ev evi", """
    SELECT key, arg_min(x, struct_pack(y := y, i := idx)) AS min_x, min(y) AS min_y, arg_max(x, struct_pack(y := y, i := idx)) AS max_x,
           max(y) AS max_y, arg_max(x, idx) AS last_x, arg_max(y, idx) AS last_y FROM evi GROUP BY key"""))
def w_spark(spark, sf):
    return S.spark_points(evi(spark, sf)).drop("chart")


@query("w16_tail", with_("pts", """
    SELECT key, idx, x, y FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY x DESC, idx DESC) AS rn FROM pts) WHERE rn <= 70"""))
def w_tail(spark, sf):
    return S.tail(c.event_points(spark, sf), 70, ["key"], ["x", "idx"]).select("key", "idx", "x", "y")


# ---------------------------------------------------------------- aggregates over series
@query("a08_extent", with_("ev", """
    SELECT least(min(x), 19720)::DOUBLE AS x_lo, max(x)::DOUBLE AS x_hi, least(min(y), 0.0) AS y_lo, max(y) AS y_hi FROM ev"""))
def a_extent(spark, sf):
    return S.extent(c.event_series(spark, sf), ["chart"], ["x", "y"], {"x": [19720], "y": [0]}).drop("chart")


@query("a08_extent_log", with_("ev", """
    , z AS (SELECT CASE WHEN x % 7 = 0 THEN 0.0 ELSE y END AS y FROM ev)
    SELECT round(least(min(y) FILTER (y <> 0), 0.1 * min(y) FILTER (y <> 0)), 6) + 0.0 AS y_lo, max(y) AS y_hi FROM z"""))
def a_extent_log(spark, sf):
    z = c.event_series(spark, sf).withColumn("y", F.when(F.col("x") % 7 == 0, 0.0).otherwise(F.col("y")))
    return rounded(S.extent(z, ["chart"], ["y"], log="y").drop("chart"), ["y_lo"])


@query("a14_area_total", with_("ev", """
    SELECT series_idx % 2 AS axis, x, round(sum(y), 4) + 0.0 AS y FROM ev GROUP BY ALL
    UNION ALL SELECT DISTINCT series_idx % 2, 0, 0.0 FROM ev"""))
def a_area(spark, sf):
    return rounded(S.area_total(c.event_series(spark, sf).withColumn("axis", F.col("series_idx") % 2)), ["y"], 4)


@query("a18_max_len", with_("ev li", """
    SELECT chart, max(n) AS max_len FROM (SELECT chart, key, count(*) AS n FROM (SELECT chart, key FROM ev UNION ALL SELECT chart, key FROM li) GROUP BY ALL) GROUP BY chart"""))
def a_max_len(spark, sf):
    return S.max_len(S.merge_points(c.event_series(spark, sf), c.item_series(spark, sf)))


@query("u01_merge_points", with_("ev li", "SELECT chart, key, x, y FROM ev UNION ALL SELECT chart, key, x, y FROM li UNION ALL SELECT chart, key, x, y FROM ev"))
def u_merge(spark, sf):
    e = c.event_series(spark, sf)
    return S.merge_points(e, c.item_series(spark, sf), e).select("chart", *COLS)


# ---------------------------------------------------------------- lookups
_NEAREST = with_("pts probes", """
    , n AS (SELECT p.probe_id, p.key, p.at, q.idx, q.x, q.y, row_number() OVER (PARTITION BY p.probe_id ORDER BY abs(q.x - p.at),
              CASE WHEN q.x < p.at THEN 0 ELSE 1 END, CASE WHEN q.x < p.at THEN -q.idx ELSE q.idx END) AS rn
            FROM probes p JOIN pts q ON p.key = q.key)
    SELECT probe_id, key, "at", idx, x, y FROM n WHERE rn = 1""")


@query("j05_nearest", _NEAREST)
def j_nearest(spark, sf):
    out = lookup.nearest(c.event_points(spark, sf), c.doc_probes(spark, sf).select("probe_id", "key", "at"), ["key"])
    return out.select("probe_id", "key", "at", "idx", "x", "y")


def _value_probes(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(
        F.col("doc_id").alias("probe_id"), (F.col("doc_id") % 30 + DAY0).alias("x"),
        ((F.col("n_chars") * 31) % 4000 + 1000).cast("double").alias("at"),
    )


@query("j06_nearest_within", with_("ev", f"""
    , p AS (SELECT doc_id AS probe_id, doc_id % 30 + {DAY0} AS x, CAST((n_chars * 31) % 4000 + 1000 AS DOUBLE) AS at FROM documents),
    n AS (SELECT p.probe_id, p.x, p.at, e.series_idx AS idx, row_number() OVER (PARTITION BY p.probe_id ORDER BY abs(p.at - e.y), e.series_idx DESC) AS rn
          FROM p LEFT JOIN ev e ON p.x = e.x AND abs(p.at - e.y) < 150)
    SELECT probe_id, x, "at", idx FROM n WHERE rn = 1"""))
def j_within(spark, sf):
    return lookup.nearest_within(ev(spark, sf), _value_probes(spark, sf), ["x"], 150.0, value="y", idx="series_idx")


@query("j07_closest_index", """
    WITH p AS (SELECT doc_id AS probe_id, ['click', 'error', 'purchase', 'signup', 'view'][CAST(doc_id % 5 AS INTEGER) + 1] AS key,
               CAST(n_chars % 200 AS DOUBLE) AS at FROM documents),
    n AS (SELECT p.probe_id, p.key, p.at, e.event_id AS idx, row_number() OVER (PARTITION BY p.probe_id ORDER BY abs(e.value - p.at), e.event_id) AS rn
          FROM p JOIN events e ON e.event_type = p.key)
    SELECT probe_id, key, "at", idx FROM n WHERE rn = 1""")
def j_closest(spark, sf):
    points = table(spark, sf, "events").select(F.col("event_type").alias("key"), F.col("value").alias("x"), F.col("event_id").alias("idx"))
    probes = c.doc_probes(spark, sf).select("probe_id", "key", (F.col("n_chars") % 200).cast("double").alias("at"))
    return lookup.closest_index(points, probes, ["key"])


@query("j08_band_at", with_("ev", f"""
    , p AS (SELECT doc_id AS probe_id, doc_id % 30 + {DAY0} AS x, CAST((n_chars * 31) % 20000 AS DOUBLE) AS at FROM documents),
    b AS (SELECT x, series_idx, coalesce(sum(y) OVER (PARTITION BY x ORDER BY series_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y0, y FROM ev)
    SELECT p.probe_id, p.x, p.at, min(b.series_idx) AS series_idx FROM p LEFT JOIN b ON p.x = b.x AND p.at BETWEEN b.y0 AND b.y0 + b.y GROUP BY ALL"""))
def j_band(spark, sf):
    stacked = S.stack(c.event_series(spark, sf), "zero")
    docs = table(spark, sf, "documents")
    probes = docs.select(
        F.col("doc_id").alias("probe_id"), F.lit("events").alias("chart"), (F.col("doc_id") % 30 + DAY0).alias("x"),
        ((F.col("n_chars") * 31) % 20000).cast("double").alias("at"),
    )
    return lookup.band_at(stacked, probes).drop("chart")


@query("a15_cross_section", with_("ev gappy", f"""
    , p AS (SELECT doc_id AS probe_id, {DAY0} + (doc_id * 37 % 3100) / 100.0::DOUBLE AS at FROM documents),
    n AS (SELECT p.probe_id, q.key, q.y, row_number() OVER (PARTITION BY p.probe_id, q.key ORDER BY abs(q.x - p.at), q.x) AS rn FROM p CROSS JOIN gappy q),
    r AS (SELECT probe_id, key, y AS value, FALSE AS total FROM n WHERE rn = 1)
    SELECT probe_id, key, round(value, 4) + 0.0 AS value, total FROM r
    UNION ALL SELECT probe_id, 'TOTAL', round(sum(value), 4) + 0.0, TRUE FROM r GROUP BY probe_id HAVING count(value) > 0 AND count(*) >= 2"""))
def a_cross(spark, sf):
    points = materialise(S.point_index(materialise(c.gappy_series(spark, sf), "gappy")), "indexed")
    at = F.lit(float(DAY0)) + (F.col("doc_id") * 37 % 3100) / F.lit(100.0)
    probes = table(spark, sf, "documents").select(F.lit("events").alias("chart"), F.col("doc_id").alias("probe_id"), at.alias("at"))
    return rounded(lookup.cross_section(points, probes).drop("chart"), ["value"], 4)


@query("u02_unique_sorted", "SELECT conv_id, array_to_string(list_sort(list_distinct(list(role))), ',') AS roles FROM conversations GROUP BY conv_id")
def u_unique(spark, sf):
    talks = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("v"))
    return filters.unique_sorted(talks, ["conv_id"], "v").select("conv_id", F.array_join("values", ",").alias("roles"))


@query("u03_arrays_equal", """
    SELECT a.vec_id, a.embedding = b.embedding AS same FROM embeddings a JOIN embeddings b ON a.label = b.vec_id""")
def u_equal(spark, sf):
    e = table(spark, sf, "embeddings")
    a, b = e.select("vec_id", "label", F.col("embedding").alias("a")), e.select(F.col("vec_id").alias("label"), F.col("embedding").alias("b"))
    return a.join(b, "label").select("vec_id", filters.arrays_equal(F.col("a"), F.col("b")).alias("same"))
