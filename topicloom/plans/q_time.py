"""Queries: sources, sinks and topic weight over time."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import (
    bin_left, bin_right_closed, bin_right_closed_edge, borders, epoch_millis, epoch_seconds,
    parse_epoch_seconds, split_line, strip_cast,
)
from ..operators import filters, joins, output, shares, timebins
from ..session import fresh_path, materialise
from ..sources import readers, synthetic
from . import corpus as c
from .corpus import BINS, HI, LO, TOPICS, with_
from .registry import query, rnd, rounded, table

KEYS = [f"topic_{i}" for i in range(TOPICS)]


def series(spark, sf, **kw):
    return timebins.topic_series(c.doc_topic_time(spark, sf), "ts", "weights", TOPICS, LO, HI, BINS, **kw)


def _long(agg: str) -> str:
    return with_("doc_topic dtt borders binned", f"""
        SELECT bin, 'topic_' || i AS key, round({agg}(weights[i + 1]), 9) + 0.0 AS y
        FROM binned, range({TOPICS}) r(i) GROUP BY bin, i""")


@query("a01_topic_series", _long("sum"))
def topic_series(spark, sf):
    return rounded(output.unpivot(series(spark, sf), "bin", KEYS), ["y"], 9)


@query("a02_doc_counts", with_("meta borders", f"""
    SELECT b.bin, count(*) AS count FROM meta m ASOF JOIN borders b ON m.t >= b.bin
    WHERE m.t > {LO} AND m.t < {HI} GROUP BY b.bin"""))
def doc_counts(spark, sf):
    return timebins.doc_counts(c.meta(spark, sf), "ts", LO, HI, BINS)


@query("a03_topic_averages", _long("avg"))
def topic_averages(spark, sf):
    return rounded(output.unpivot(series(spark, sf, agg=F.avg), "bin", KEYS), ["y"], 9)


@query("a01_topic_series_filled", with_("doc_topic dtt borders binned", f"""
    , sums AS (SELECT bin, i, sum(weights[i + 1]) AS y FROM binned, range({TOPICS}) r(i) GROUP BY bin, i)
    SELECT b.bin, 'topic_' || r.i AS key, round(coalesce(y, 0), 9) + 0.0 AS y
    FROM borders b CROSS JOIN range({TOPICS}) r(i) LEFT JOIN sums s ON s.bin = b.bin AND s.i = r.i"""))
def topic_series_filled(spark, sf):
    return rounded(output.unpivot(series(spark, sf, fill_empty=True), "bin", KEYS), ["y"], 9)


def _loaded(spark, sf):
    """Tuples and ISO dates written as text and read again, joined by id."""
    weights, dates = fresh_path(spark, "tuples"), fresh_path(spark, "dates")
    line = F.concat(F.lit("("), F.col("doc_id"), F.lit(",("), F.array_join(F.col("weights").cast("array<string>"), ","), F.lit("))"))
    c.doc_topic(spark, sf).select(line.alias("value")).write.text(weights)
    messages = c.times(spark, sf).select(
        c.thread(spark, sf, F.col("doc_id")).alias("id"),
        F.when(F.col("doc_id") % 50 == 0, F.lit("no date")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("date"),
        F.lit("a").alias("from"), F.array(F.lit("b")).alias("to"), F.lit("c").alias("subject"),
    )
    messages.write.parquet(dates)
    meta = readers.read_meta(spark, dates, fmt="parquet").select(F.col("id").alias("doc_id"), "date")
    return joins.with_metadata(readers.read_tuples(spark, weights, TOPICS), meta)


_DATED = "doc_topic dtt borders binned"


@query("a01_from_text_files", with_(_DATED, f"""
    SELECT bin, 'topic_' || i AS key, round(sum(weights[i + 1]), 9) + 0.0 AS y
    FROM binned, range({TOPICS}) r(i) WHERE doc_id % 50 <> 0 GROUP BY bin, i"""))
def series_from_text(spark, sf):
    found = timebins.topic_series(_loaded(spark, sf), "date", "weights", TOPICS, LO, HI, BINS)
    return rounded(output.unpivot(found, "bin", KEYS), ["y"], 9)


@query("a02_from_text_files", with_(_DATED, "SELECT bin, count(*) AS count FROM binned WHERE doc_id % 50 <> 0 GROUP BY bin"))
def counts_from_text(spark, sf):
    return timebins.doc_counts(_loaded(spark, sf), "date", LO, HI, BINS)


@query("a04_time_extent", with_("meta", "SELECT min(t) AS min_ts, max(t) AS max_ts FROM meta"))
def time_extent(spark, sf):
    return timebins.time_extent(c.meta(spark, sf), "ts")


@query("a19_span", with_("meta", """
    SELECT round((max(t) - min(t)) / (365.0 * 24 * 3600), 9) + 0.0 AS years,
           round((max(t) - min(t)) / (365.0 * 24 * 3600) * 12, 9) + 0.0 AS months FROM meta"""))
def span(spark, sf):
    return rounded(timebins.span(c.meta(spark, sf), "ts"), ["years", "months"], 9)


_CUT = with_("doc_topic dtt", """
    , m AS (SELECT doc_id, weights, CAST(epoch_us(ts) // 1000 AS DOUBLE) AS x FROM dtt),
    e AS (SELECT min(x) AS lo, max(x) AS hi FROM m),
    k AS (SELECT m.*, greatest(0, CAST(ceil((x - lo) / ((hi - lo) / 80.0)) AS INTEGER) - 1) AS bin FROM m, e),
    s AS (SELECT least(bin, 79) AS bin, j, sum(weights[j + 1]) AS y FROM k, range(TOPICS) q(j) GROUP BY ALL)
    SELECT CAST(r.i AS INTEGER) AS bin, 'topic_' || q.j AS key,
           round(CASE WHEN r.i = 0 THEN lo - (hi - lo) * 0.001 ELSE lo + r.i * ((hi - lo) / 80.0) END, 2) + 0.0 AS bin_lo,
           round(coalesce(y, 0), 9) + 0.0 AS y
    FROM range(80) r(i) CROSS JOIN range(TOPICS) q(j) CROSS JOIN e LEFT JOIN s ON s.bin = r.i AND s.j = q.j""").replace("TOPICS", str(TOPICS))


@query("a06_cut_sum", _CUT)
def cut_sum(spark, sf):
    d = c.doc_topic_time(spark, sf)
    values = [(name, F.get("weights", F.lit(i))) for i, name in enumerate(KEYS)]
    at = c.times(spark, sf).withColumn("thread", c.thread(spark, sf, F.col("doc_id")))
    at = at.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("thread")), "thread", "left_semi")
    out = timebins.cut_sum(d, epoch_millis(F.col("ts")), values, 80, at)
    long = out.unpivot(["bin", "bin_lo"], KEYS, "key", "y")
    return rounded(rounded(long, ["y"], 9), ["bin_lo"], 2)


@query("a07_weight_check", """
    WITH s AS (SELECT vec_id AS doc_id, list_sum(list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE)))) AS total
               FROM embeddings)
    SELECT doc_id, round(total, 9) + 0.0 AS total FROM s WHERE abs(total - 1.0) > 0.5""")
def weight_check(spark, sf):
    raw = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("weights")
    )
    return rounded(shares.weight_check(raw, "doc_id", "weights", 0.5), ["total"], 9)


@query("a05_distinct_count", """
    SELECT count(DISTINCT url) AS distinct_count FROM pages WHERE NOT contains(url, 'example.com')""")
def distinct_count(spark, sf):
    return filters.distinct_count(filters.contains(table(spark, sf, "pages"), "url", "example.com", negate=True), "url")


# ---------------------------------------------------------------- bins and times
_BINS77 = f"""
    WITH b AS (SELECT k, {LO} + (k * {HI - LO - 12345}) // 77 AS bin FROM range(77) r(k)),
    e AS (SELECT event_id, epoch_us(ts) // 1000000 AS t FROM events)
    SELECT event_id, t, bin FROM e ASOF LEFT JOIN b ON e.t >= b.bin"""


@query("f03_bin_left", _BINS77)
def f_bin_left(spark, sf):
    e = table(spark, sf, "events").select("event_id", epoch_seconds(F.col("ts")).alias("t"))
    return e.withColumn("bin", bin_left(F.col("t"), LO, HI - 12345, 77))


@query("f04_bin_right_closed", """
    WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
    SELECT event_id, CAST(greatest(0, ceil((value - lo) / ((hi - lo) / 80.0)) - 1) AS INTEGER) AS bin
    FROM events, e""")
def f_bin_right(spark, sf):
    e = table(spark, sf, "events")
    ends = e.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).select(F.struct("lo", "hi")).scalar()
    return e.select("event_id", bin_right_closed(F.col("value"), ends["lo"], ends["hi"], 80).alias("bin"))


@query("f05_bin_edges", """
    WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
    k AS (SELECT DISTINCT least(greatest(0, CAST(ceil((l_extendedprice - lo) / ((hi - lo) / 80.0)) AS INTEGER) - 1), 79) AS bin, lo, hi
          FROM lineitem, e)
    SELECT bin, round(CASE WHEN bin = 0 THEN lo - (hi - lo) * 0.001 ELSE lo + bin * ((hi - lo) / 80.0) END, 7) + 0.0 AS bin_lo
    FROM k""")
def f_bin_edges(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("v"))
    ends = e.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).select(F.struct("lo", "hi")).scalar()
    bins = e.select(bin_right_closed(F.col("v"), ends["lo"], ends["hi"], 80).alias("bin")).distinct()
    return bins.select("bin", rnd(bin_right_closed_edge(F.col("bin"), ends["lo"], ends["hi"], 80), 7).alias("bin_lo"))


@query("f06_borders", f"""
    WITH b AS (SELECT {LO} + (k * {HI - LO - 12345}) // 77 AS border FROM range(77) r(k)),
    e AS (SELECT epoch_us(ts) // 1000000 AS t FROM events),
    n AS (SELECT b.border, count(*) AS events FROM e ASOF JOIN b ON e.t >= b.border GROUP BY b.border)
    SELECT border, coalesce(events, 0) AS events FROM b LEFT JOIN n USING (border)""")
def f_borders(spark, sf):
    t = table(spark, sf, "events").select(epoch_seconds(F.col("ts")).alias("t"))
    per = t.groupBy(bin_left(F.col("t"), LO, HI - 12345, 77).alias("border")).agg(F.count(F.lit(1)).alias("n"))
    edges = spark.range(1).select(F.explode(borders(LO, HI - 12345, 77)).alias("border"))
    return edges.join(per, "border", "left").select("border", F.coalesce("n", F.lit(0)).alias("events"))


@query("f01_epoch_seconds", with_("mail", """
    SELECT id, t AS timestamp, CAST(NULL AS BIGINT) AS bad FROM mail"""))
def f_epoch(spark, sf):
    return c.mail(spark, sf).select(
        "id", parse_epoch_seconds(F.col("date")).alias("timestamp"),
        parse_epoch_seconds(F.concat(F.lit("x"), F.col("date"))).alias("bad"),
    )


@query("f02_epoch_millis", "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
def f_millis(spark, sf):
    return table(spark, sf, "events").select("event_id", epoch_millis(F.col("ts")).alias("ms"))


@query("f07_strip_cast", """
    SELECT l_orderkey, l_linenumber, l_extendedprice AS price, CAST(NULL AS DOUBLE) AS bad FROM lineitem""")
def f_strip(spark, sf):
    li = table(spark, sf, "lineitem")
    dumped = F.concat(F.lit("["), F.col("l_extendedprice").cast("string"), F.lit("))"))
    return li.select(
        "l_orderkey", "l_linenumber", strip_cast(dumped, 1, 2, "double").alias("price"),
        strip_cast(dumped, 0, 2, "double").alias("bad"),
    )


@query("f09_split_line", "SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer")
def f_split(spark, sf):
    cu = table(spark, sf, "customer")
    line = F.concat_ws("\t", F.concat(F.lit("  "), F.col("c_name")), F.concat(F.col("c_mktsegment"), F.lit(" \r\n")))
    f = split_line(line)
    return cu.select("c_custkey", F.get(f, F.lit(0)).alias("name"), F.get(f, F.lit(1)).alias("segment"))


# ---------------------------------------------------------------- sources
@query("s01_meta_scan", with_("mail", """
    SELECT id, t AS timestamp, "from" AS sender, len("to") AS n_to, subject FROM mail"""))
def s_meta(spark, sf):
    path = fresh_path(spark, "meta")
    c.mail(spark, sf).write.parquet(path)
    m = readers.read_meta(spark, path, fmt="parquet")
    return m.select(
        "id", parse_epoch_seconds(F.col("date")).alias("timestamp"), F.col("from").alias("sender"),
        F.size("to").cast("bigint").alias("n_to"), "subject",
    )


@query("s02_delimited_scan", """
    SELECT p_partkey AS id, p_name AS name, p_size AS size, p_retailprice AS price FROM part""")
def s_delimited(spark, sf):
    path = fresh_path(spark, "parts")
    table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_retailprice").write.csv(path, sep="\t")
    schema = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
        T.StructField("size", T.IntegerType()), T.StructField("price", T.DoubleType()),
    ])
    return readers.read_delimited(spark, path, schema, sep="\t")


@query("s03_tuple_scan", with_("doc_topic", """
    SELECT doc_id, CAST(i AS INTEGER) AS topic, weights[i + 1] AS weight FROM doc_topic, range(64) r(i)"""))
def s_tuples(spark, sf):
    path = fresh_path(spark, "tuples")
    line = F.concat(F.lit("("), F.col("doc_id"), F.lit(",("), F.array_join(F.col("weights").cast("array<string>"), ","), F.lit("))"))
    c.doc_topic(spark, sf).select(line.alias("value")).write.text(path)
    return readers.weights_long(readers.read_tuples(spark, path, TOPICS)).withColumnRenamed("col", "topic")


@query("s03_tuple_wide", with_("doc_topic", "SELECT doc_id, " + ", ".join(f"weights[{i + 1}] AS C{i + 1}" for i in range(TOPICS)) + " FROM doc_topic"))
def s_tuples_wide(spark, sf):
    path = fresh_path(spark, "tuples")
    line = F.concat(F.lit("("), F.col("doc_id"), F.lit(",["), F.array_join(F.col("weights").cast("array<string>"), ", "), F.lit("])"))
    c.doc_topic(spark, sf).select(line.alias("value")).write.text(path)
    wide = readers.weights_wide(readers.read_tuples(spark, path, TOPICS), TOPICS)
    return wide.select("doc_id", *filters.numbered_columns("C", TOPICS))


_MATRIX = with_("cluster_topic", """
    , rows AS (SELECT topic, dense_rank() OVER (ORDER BY topic) - 1 AS n FROM (SELECT DISTINCT topic FROM cluster_topic)),
    cols AS (SELECT cluster, dense_rank() OVER (ORDER BY cluster) - 1 AS col FROM (SELECT DISTINCT cluster FROM cluster_topic WHERE cluster IS NOT NULL))
    SELECT r.{row} AS row, CAST(c.col AS INTEGER) AS col, coalesce(t.weight, 0.0) AS value
    FROM rows r CROSS JOIN cols c LEFT JOIN cluster_topic t ON t.topic = r.topic AND t.cluster = c.cluster""")


def _dense(spark, sf):
    clusters = output.names_of(table(spark, sf, "documents"), "lang")
    wide = c.cluster_topic(spark, sf).groupBy("topic").pivot("cluster", clusters).agg(F.first("weight"))
    cells = [F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).cast("string") for n in clusters]
    return wide.select("topic", F.concat_ws(",", *cells).alias("cells"))


@query("s04_matrix_scan", _MATRIX.replace("{row}", "topic"))
def s_matrix(spark, sf):
    path = fresh_path(spark, "matrix")
    _dense(spark, sf).select(F.concat_ws(",", F.col("topic").cast("string"), "cells")).write.text(path)
    return readers.read_matrix(spark, path, row_id=True)


@query("s04_matrix_scan_file_order", _MATRIX.replace("{row}", "n"))
def s_matrix_order(spark, sf):
    path = fresh_path(spark, "matrix")
    _dense(spark, sf).orderBy("topic").select("cells").write.text(path)
    return readers.read_matrix(spark, path)


@query("s05_vocab_scan", with_("words vocab", "SELECT word_id, word, count FROM vocab"))
def s_vocab(spark, sf):
    path = fresh_path(spark, "vocab")
    v = c.vocab(c.source_words(spark, sf))
    v.select(F.concat_ws("\t", F.col("word_id").cast("string"), "word", F.col("count").cast("string"))).write.text(path)
    return readers.read_vocab(spark, path)


@query("s06_matrix_json", with_("sim", "SELECT i, CAST(dense_rank() OVER (ORDER BY j) - 1 AS INTEGER) AS j, sim FROM sim"))
def s_matrix_json(spark, sf):
    path = fresh_path(spark, "sim")
    row = F.transform(F.array_sort(F.collect_list(F.struct("j", "sim"))), lambda s: s["sim"])
    named = c.topic_sim(spark, sf).groupBy("i").agg(row.alias("cells"))
    named.select(F.to_json(F.create_map(F.concat(F.lit("topic_"), F.col("i")), F.col("cells")))).write.text(path)
    return readers.read_matrix_json(spark, path)


@query("s08_generated_weights")
def s_generated(spark, sf):
    made = synthetic.gen_doc_topic(table(spark, sf, "documents").select("doc_id"), 10, LO, HI, seed=7)
    return made.select("doc_id", "ts", F.posexplode("weights").alias("topic", "weight"))


@query("s09_waves", """
    WITH p AS (SELECT doc_id AS series_idx, CAST(j AS INTEGER) AS x, 20.0::DOUBLE * j / 30 - doc_id / 3.0::DOUBLE AS v
               FROM documents, range(30) r(j))
    SELECT series_idx, x, round(greatest(0.0, 2 * v * exp(-0.5 * v)), 9) + 0.0 AS y FROM p""")
def s_waves(spark, sf):
    layers = table(spark, sf, "documents").select(F.col("doc_id").alias("series_idx"))
    return rounded(synthetic.gen_waves(layers, 0, 30), ["y"], 9)


# ---------------------------------------------------------------- sinks and reshaping
@query("k01_series", _long("sum").replace("SELECT bin,", "SELECT bin AS x,"))
def k_series(spark, sf):
    nested = output.to_series(series(spark, sf), "bin", KEYS)
    return rounded(nested.select("key", F.inline("values")), ["y"], 9)


@query("k01_series_parts", with_("pts", """
    , n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY x, y) - 1 AS i FROM pts)
    SELECT key, i // 500 AS part, CAST(i % 500 AS INTEGER) AS pos, x, y FROM n"""))
def k_series_parts(spark, sf):
    parts = output.series_parts(c.event_points(spark, sf), ["key"], "x", "y", points=500)
    return parts.select("key", "part", F.posexplode("values").alias("pos", "p")).select("key", "part", "pos", "p.x", "p.y")


@query("k02_pairs", with_("meta borders", f"""
    , n AS (SELECT b.bin AS x, count(*) AS y FROM meta m ASOF JOIN borders b ON m.t >= b.bin
            WHERE m.t > {LO} AND m.t < {HI} GROUP BY b.bin)
    SELECT CAST(row_number() OVER (ORDER BY x) - 1 AS INTEGER) AS pos, x, y FROM n"""))
def k_pairs(spark, sf):
    pairs = output.to_pairs(doc_counts(spark, sf), "bin", "count")
    return pairs.select(F.posexplode("pairs").alias("pos", "p")).select("pos", "p.x", "p.y")


@query("k04_json", _long("sum"))
def k_json(spark, sf):
    path = fresh_path(spark, "json")
    output.write_json(topic_series(spark, sf), path)
    return spark.read.schema("bin BIGINT, key STRING, y DOUBLE").json(path)


@query("k05_materialised_join", with_("doc_topic dtt", """
    SELECT t // 86400 AS day, count(*) AS docs, """ + ", ".join(f"round(sum(weights[{i + 1}]), 9) + 0.0 AS topic_{i}" for i in range(TOPICS)) + """
    FROM dtt WHERE t // 86400 >= 19730 GROUP BY ALL"""))
def k_materialised(spark, sf):
    joined = c.doc_topic_time(spark, sf).withColumn("day", c.day("ts"))
    kept = materialise(joined, "doc-topic-time", ["day"])
    out = kept.where(F.col("day") >= 19730).groupBy("day").agg(
        F.count(F.lit(1)).alias("docs"), *[F.sum(F.get("weights", F.lit(i))).alias(k) for i, k in enumerate(KEYS)]
    )
    return rounded(out, KEYS, 9)


DAYS = [c.DAY0 + i for i in range(30)]


@query("k06_transpose", with_("ev", "SELECT key, " + ", ".join(f"max(CASE WHEN x = {d} THEN y END) AS d{d}" for d in DAYS) + " FROM ev GROUP BY key"))
def k_transpose(spark, sf):
    types = output.names_of(table(spark, sf, "events"), "event_type")
    wide = c.event_series(spark, sf).groupBy("x").pivot("key", types).agg(F.first("y"))
    out = output.transpose(wide, "x", types, DAYS)
    return out.select("key", *[F.col(str(d)).alias(f"d{d}") for d in DAYS])


@query("k06_transpose_long", with_("ev", "SELECT x, key, y FROM ev"))
def k_transpose_long(spark, sf):
    types = output.names_of(table(spark, sf, "events"), "event_type")
    wide = c.event_series(spark, sf).groupBy("x").pivot("key", types).agg(F.first("y"))
    return output.transpose(wide, "x", types).where(F.col("y").isNotNull())


@query("k08_peek", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 20")
def k_peek(spark, sf):
    return output.peek(table(spark, sf, "events").select("event_id", "event_type").orderBy("event_id"), 20)


# ---------------------------------------------------------------- projections and filters
@query("p01_projection", "SELECT doc_id AS id, n_chars AS count FROM documents")
def p_project(spark, sf):
    return filters.project(table(spark, sf, "documents"), {"id": "doc_id", "count": "n_chars"})


@query("p02_numbered_columns", with_("doc_topic", "SELECT doc_id, " + ", ".join(f"weights[{i + 1}] AS C{i + 1}" for i in range(TOPICS)) + " FROM doc_topic"))
def p_columns(spark, sf):
    return readers.weights_wide(c.doc_topic(spark, sf), TOPICS).select("doc_id", *filters.numbered_columns("C", TOPICS))


@query("p03_replace_column", "SELECT doc_id, upper(lang) AS lang FROM documents")
def p_replace(spark, sf):
    return filters.replace_column(table(spark, sf, "documents").select("doc_id", "lang"), "lang", F.upper("lang"))


@query("p04_open_range", f"""
    SELECT event_id FROM events WHERE epoch_us(ts) // 1000000 > {LO + 86400} AND epoch_us(ts) // 1000000 < {HI - 864000}""")
def p_range(spark, sf):
    return timebins.between_open(table(spark, sf, "events"), "ts", LO + 86400, HI - 864000).select("event_id")


@query("p04_out_of_range", f"""
    SELECT count(*) FILTER (ts IS NULL) AS no_time, count(*) FILTER (epoch_us(ts) // 1000000 <= {LO + 86400}) AS early,
           count(*) FILTER (epoch_us(ts) // 1000000 >= {HI - 864000}) AS late FROM events""")
def p_out(spark, sf):
    return timebins.out_of_range(table(spark, sf, "events"), "ts", LO + 86400, HI - 864000)


@query("p05_prefix", "SELECT doc_id, source FROM documents WHERE starts_with(source, 'src1')")
def p_prefix(spark, sf):
    return filters.starts_with(table(spark, sf, "documents"), "source", "src1").select("doc_id", "source")


@query("p06_any_prefix", with_("mail", """SELECT id FROM mail WHERE len(list_filter("to", lambda v: starts_with(v, 'sys'))) > 0"""))
def p_any(spark, sf):
    return filters.any_starts_with(c.mail(spark, sf), "to", "sys").select("id")


@query("p07_contains", "SELECT doc_id FROM documents WHERE contains(text, 'the')")
def p_contains(spark, sf):
    return filters.contains(table(spark, sf, "documents"), "text", "the").select("doc_id")


@query("p07_contains_not", "SELECT doc_id FROM documents WHERE NOT contains(text, 'the')")
def p_contains_not(spark, sf):
    return filters.contains(table(spark, sf, "documents"), "text", "the", negate=True).select("doc_id")


@query("p08_array_facts", with_("mail", """
    SELECT id, "to"[1] AS first, CAST(len("to") AS INTEGER) AS size, list_contains("to", 'system') AS has_member FROM mail"""))
def p_array(spark, sf):
    return filters.array_facts(c.mail(spark, sf), "id", "to", "system")


@query("p09_keep_keys", with_("ev", "SELECT key, x, y FROM ev WHERE key IN ('click', 'view')"))
def p_keep(spark, sf):
    return filters.keep_keys(c.event_series(spark, sf), "key", ["click", "view"]).select("key", "x", "y")


# ---------------------------------------------------------------- joins
@query("j01_weights_with_meta", with_("doc_topic meta", """
    SELECT doc_id, version, lang, source, list_transform(weights, lambda v: round(v, 9) + 0.0) AS weights FROM doc_topic JOIN meta USING (doc_id)"""))
def j_meta(spark, sf):
    joined = joins.with_metadata(c.doc_topic(spark, sf), c.meta(spark, sf))
    return joined.select("doc_id", "version", "lang", "source", F.transform("weights", lambda v: rnd(v, 9)).alias("weights"))


@query("o01_sorted_bins", with_("meta borders", f"""
    SELECT b.bin, count(*) AS count FROM meta m ASOF JOIN borders b ON m.t >= b.bin
    WHERE m.t > {LO} AND m.t < {HI} GROUP BY b.bin ORDER BY b.bin"""))
def o_sorted(spark, sf):
    return doc_counts(spark, sf).orderBy("bin")


@query("o02_sorted_by_date", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey")
def o_date(spark, sf):
    return table(spark, sf, "orders").orderBy("o_orderdate", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("o04_first_row", "SELECT event_id, event_type FROM events ORDER BY ts, event_id LIMIT 1")
def o_first(spark, sf):
    return table(spark, sf, "events").orderBy("ts", "event_id").limit(1).select("event_id", "event_type")


@query("u04_distinct", "SELECT DISTINCT user_id FROM events")
def u_distinct(spark, sf):
    return filters.distinct_values(table(spark, sf, "events"), "user_id")
