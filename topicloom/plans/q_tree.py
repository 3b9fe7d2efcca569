"""Queries: cluster trees and topic graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ancestors, label, link_width
from ..operators import ancestry, graph, joins, output, shares, tree
from ..operators.scan import row_number
from ..session import fresh_path, materialise
from ..sources import readers
from . import corpus as c
from .corpus import with_
from .registry import query, rnd, rounded, table

CUT = "words vocab topic_word word_cut"
TREE = CUT + " cluster_topic topic_cut tree"


def word_cut(spark, sf, terms=True):
    words = c.source_words(spark, sf)
    vocab = c.vocab(words)
    cut = shares.mass_cut(c.topic_word(words, vocab), ["topic"], "word_id", "weight", 0.20)
    return (cut, vocab) if terms else cut


def topic_cut(spark, sf):
    return shares.mass_cut(materialise(c.cluster_topic(spark, sf), "clusters"), ["cluster"], "topic", "weight", 0.40)


def tree_rows(spark, sf):
    """Cut tree as ``cluster, topic, topic_rank, word, size, word_rank``."""
    cut, vocab = word_cut(spark, sf)
    return materialise(joins.lookup_words(joins.cluster_topic_words(topic_cut(spark, sf), cut), vocab), "tree")


def doc_leaves(spark, sf):
    """Tree of all documents: language, source, document, sized by length."""
    docs = table(spark, sf, "documents")
    topic = F.substring("source", F.lit(4), F.length("source")).cast("bigint")
    langs = docs.select(F.col("lang").alias("code")).distinct()  # one row per language
    ranks = langs.withColumn("at", F.row_number().over(Window.orderBy(F.col("code").asc_nulls_first())))
    docs = docs.join(ranks, F.col("lang").eqNullSafe(F.col("code")))
    return docs.select(
        F.lit("docs").alias("tree"),
        F.array("lang", "source", F.col("doc_id").cast("string")).alias("path"),
        F.array(F.col("at").cast("bigint"), topic, F.col("doc_id")).alias("ord"),
        F.col("n_chars").cast("double").alias("size"),
    )


@query("w01_mass_cut_words", with_(CUT, "SELECT topic, word_id, round(share, 9) + 0.0 AS share, round(cum, 9) + 0.0 AS cum, rank FROM word_cut"))
def w_words(spark, sf):
    cut = word_cut(spark, sf, terms=False)
    return rounded(cut.select("topic", "word_id", "share", "cum", "rank"), ["share", "cum"], 9)


@query("w01_mass_cut_topics", with_("cluster_topic topic_cut", "SELECT cluster, topic, round(share, 9) + 0.0 AS share, round(cum, 9) + 0.0 AS cum, rank FROM topic_cut"))
def w_topics(spark, sf):
    return rounded(topic_cut(spark, sf).select("cluster", "topic", "share", "cum", "rank"), ["share", "cum"], 9)


@query("w02_share", with_("words", "SELECT topic, word, round(weight / sum(weight) OVER (PARTITION BY topic), 9) + 0.0 AS share FROM words"))
def w_share(spark, sf):
    return rounded(shares.share(c.source_words(spark, sf), ["topic"], "weight").select("topic", "word", "share"), ["share"], 9)


@query("w02_row_share", with_("doc_topic", "SELECT doc_id, CAST(i AS INTEGER) AS topic, round(weights[i + 1], 9) + 0.0 AS share FROM doc_topic, range(64) r(i)"))
def w_row_share(spark, sf):
    return rounded(c.doc_topic(spark, sf).select("doc_id", F.posexplode("weights").alias("topic", "share")), ["share"], 9)


@query("w03_row_number", with_("words vocab", "SELECT word_id, word, count FROM vocab"))
def w_row_number(spark, sf):
    return c.vocab(c.source_words(spark, sf))


@query("w03_row_number_events", "SELECT event_id, row_number() OVER (ORDER BY value, event_id) AS rn FROM events")
def w_row_number_events(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    return row_number(e, [], ["value", "event_id"]).select("event_id", "rn")


@query("w03_row_number_parts", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem")
def w_row_number_parts(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey")
    # a limit far below the size of a group, so that groups are cut into blocks at every scale
    rn = row_number(li, ["l_returnflag"], ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"], hot_rows=5000)
    return rn.select("l_orderkey", "l_linenumber", "l_partkey", "rn")


@query("o03_share_order", with_("cluster_topic cs topic_cut".replace(" cs", ""), "SELECT cluster, topic, weight, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, topic DESC) AS rank FROM cluster_topic"))
def o_shares(spark, sf):
    return shares.rank_by_weight(c.cluster_topic(spark, sf), ["cluster"], "topic", "weight")


@query("j02_topic_words_vocab", with_("words vocab topic_word", "SELECT topic, word_id, word, weight, count FROM topic_word JOIN vocab USING (word_id)"))
def j_words(spark, sf):
    words = c.source_words(spark, sf)
    vocab = c.vocab(words)
    return joins.with_words(c.topic_word(words, vocab), vocab).select("topic", "word_id", "word", "weight", "count")


@query("j03_word_lookup", with_(CUT, "SELECT topic, rank, word, round(share, 9) + 0.0 AS size FROM word_cut LEFT JOIN vocab USING (word_id)"))
def j_lookup(spark, sf):
    cut, vocab = word_cut(spark, sf)
    out = joins.lookup_words(cut, vocab).select("topic", "rank", "word", F.col("share").alias("size"))
    return rounded(out, ["size"], 9)


@query("j03_unmatched_ids", """
    SELECT user_id AS word_id, count(*) AS rows FROM events
    WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20) GROUP BY user_id""")
def j_unmatched(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("word_id"))
    known = table(spark, sf, "customer").where(F.col("c_nationkey") < 20).select(F.col("c_custkey").alias("word_id"))
    return joins.unmatched_ids(rows, known)


@query("j04_cluster_topic_words", with_(TREE, "SELECT cluster, topic, topic_rank, word, round(size, 9) + 0.0 AS size, word_rank FROM tree"))
def j_tree(spark, sf):
    rows = tree_rows(spark, sf).select("cluster", "topic", "topic_rank", "word", "size", "word_rank")
    return rounded(rows, ["size"], 9)


def _documents(spark, sf):
    return output.tree_documents(tree_rows(spark, sf))


_NESTED = with_(TREE, """
    , placed AS (SELECT *, CAST(topic_rank - 1 AS INTEGER) AS t_ord, CAST(word_rank - 1 AS INTEGER) AS w_ord FROM tree)
    SELECT 'Cluster ' || cluster AS cluster, t_ord, 'Topic ' || topic AS topic, w_ord, word, round(size, 9) + 0.0 AS size
    FROM placed WHERE word IS NOT NULL""")


@query("k03_tree_documents", _NESTED)
def k_tree(spark, sf):
    topics = _documents(spark, sf).select(F.col("name").alias("cluster"), F.posexplode("children").alias("t_ord", "t"))
    words = topics.select("cluster", "t_ord", F.col("t.name").alias("topic"), F.posexplode("t.children").alias("w_ord", "w"))
    return rounded(words.select("cluster", "t_ord", "topic", "w_ord", F.col("w.name").alias("word"), F.col("w.size").alias("size")), ["size"], 9)


@query("k03_tree_fragments", with_(TREE, """
    , e AS (SELECT *, coalesce(word_rank = 1, TRUE) AS ot, coalesce(word_rank = max(word_rank) OVER (PARTITION BY cluster, topic), TRUE) AS zt,
            topic_rank = 1 AS t1, topic_rank = max(topic_rank) OVER (PARTITION BY cluster) AS tz,
            cluster = min(cluster) OVER () AS c1, cluster = max(cluster) OVER () AS cz FROM tree)
    SELECT cluster, topic_rank, word_rank,
           CASE WHEN ot AND t1 AND c1 THEN '{"name":"corpus","children":[' ELSE '' END || CASE WHEN ot AND t1 AND NOT c1 THEN ',' ELSE '' END ||
           CASE WHEN ot AND t1 THEN '{"name":"Cluster ' || cluster || '","children":[' ELSE '' END || CASE WHEN ot AND NOT t1 THEN ',' ELSE '' END ||
           CASE WHEN ot THEN '{"name":"Topic ' || topic || '","children":[' ELSE ',' END ||
           CASE WHEN word IS NULL THEN '' ELSE '{"name":' || CAST(to_json(word) AS VARCHAR) || ',"size":#}' END ||
           CASE WHEN zt THEN ']}' ELSE '' END || CASE WHEN zt AND tz THEN ']}' ELSE '' END || CASE WHEN zt AND tz AND cz THEN ']}' ELSE '' END AS fragment
    FROM e"""))
def k_fragments(spark, sf):
    f = output.tree_fragments(tree_rows(spark, sf), "corpus")
    # numbers are written differently by the two engines
    return f.withColumn("fragment", F.regexp_replace("fragment", r'"size":[0-9.E-]+', '"size":#'))


@query("s07_tree_any_depth", """
    SELECT array_to_string(path, '/') AS path, array_to_string(ord, '/') AS ord, size FROM (
        SELECT [lang, source, CAST(doc_id AS VARCHAR)] AS path, [dense_rank() OVER (ORDER BY lang) - 1, dense_rank() OVER (PARTITION BY lang ORDER BY source, odd) - 1,
                row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1] AS ord, CAST(n_chars AS DOUBLE) AS size
        FROM (SELECT *, 0 AS odd FROM documents))""")
def s_any_depth(spark, sf):
    path = fresh_path(spark, "tree")
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    numbered = row_number(materialise(docs, "docs"), ["lang", "source"], ["doc_id"], "at", start=0)
    first = F.dense_rank().over(Window.orderBy("lang")) - 1  # one row per language and source
    second = F.dense_rank().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = docs.select("lang", "source").distinct().withColumns({"a": first, "b": second})
    leaves = numbered.join(groups, ["lang", "source"]).select(
        F.array("lang", "source", F.col("doc_id").cast("string")).alias("path"),
        F.array(F.col("a").cast("bigint"), F.col("b").cast("bigint"), "at").alias("ord"), F.col("n_chars").cast("double").alias("size"),
    )
    output.nested_documents(leaves).orderBy("ord").select("document").write.text(path)
    read = readers.read_tree(spark, path)
    return read.select(F.array_join("path", "/").alias("path"), F.array_join(F.col("ord").cast("array<string>"), "/").alias("ord"), "size")


@query("s07_tree_json", _NESTED)
def s_tree(spark, sf):
    path = fresh_path(spark, "tree")
    output.write_json(_documents(spark, sf), path)
    t = readers.read_tree(spark, path)
    at = F.col("ord")
    out = t.select(
        F.get("path", F.lit(0)).alias("cluster"), F.get(at, F.lit(1)).cast("int").alias("t_ord"),
        F.get("path", F.lit(1)).alias("topic"), F.get(at, F.lit(2)).cast("int").alias("w_ord"),
        F.col("name").alias("word"), "size",
    )
    return rounded(out, ["size"], 9)


@query("a20_tree_totals", """
    WITH p AS (SELECT [lang, source, CAST(doc_id AS VARCHAR)] AS path, CAST(n_chars AS DOUBLE) AS size FROM documents),
    d AS (SELECT CAST(k AS INTEGER) AS depth, path[1:k] AS node, size FROM p, range(4) r(k))
    SELECT 'docs' AS tree, depth, coalesce(array_to_string(node, '/'), '') AS path, sum(size) AS size, count(*) AS count
    FROM d GROUP BY depth, node""")
def a_totals(spark, sf):
    t = tree.tree_totals(doc_leaves(spark, sf))
    return t.select("tree", "depth", F.array_join("path", "/").alias("path"), "size", "count")


@query("a20_tree_rollup", with_(TREE, """
    SELECT cluster, topic, word, round(sum(size), 9) + 0.0 AS size, count(*) AS count, CAST(grouping(cluster, topic, word) AS BIGINT) AS gid
    FROM tree WHERE word IS NOT NULL GROUP BY ROLLUP (cluster, topic, word)"""))
def a_rollup(spark, sf):
    rows = tree_rows(spark, sf).where(F.col("word").isNotNull())
    return rounded(tree.rollup_totals(rows, ["cluster", "topic", "word"], "size"), ["size"], 9)


_LAYOUT = """
    WITH leaf AS (SELECT *, {value} AS v,
        sum({value}) OVER (ORDER BY lang, CAST(substr(source, 4) AS BIGINT), doc_id) - {value} AS s FROM documents),
    tot AS (SELECT sum(v) AS r FROM leaf),
    n AS (SELECT lang || '/' || source || '/' || doc_id AS path, 3 AS depth, s, v FROM leaf
          UNION ALL SELECT lang || '/' || source, 2, min(s), sum(v) FROM leaf GROUP BY lang, source
          UNION ALL SELECT lang, 1, min(s), sum(v) FROM leaf GROUP BY lang
          UNION ALL SELECT '', 0, min(s), sum(v) FROM leaf)
    SELECT path, depth, round(s / r, 9) + 0.0 AS x, round(v, 6) + 0.0 AS value, round(v / r, 9) + 0.0 AS dx FROM n, tot"""


def _layout(spark, sf, mode):
    nodes = tree.layout(doc_leaves(spark, sf), 3, mode)
    return nodes.select(F.array_join("path", "/").alias("path"), "depth", rnd("x", 9).alias("x"), rnd("value").alias("value"), rnd("dx", 9).alias("dx"))


@query("w15_layout_size", _LAYOUT.replace("{value}", "CAST(n_chars AS DOUBLE)"))
def w_layout_size(spark, sf):
    return _layout(spark, sf, "size")


@query("w15_layout_count", _LAYOUT.replace("{value}", "CAST(1 AS DOUBLE)"))
def w_layout_count(spark, sf):
    return _layout(spark, sf, "count")


@query("f18_zoom", f"SELECT path, depth, x, dx FROM ({_LAYOUT.replace('{value}', 'CAST(n_chars AS DOUBLE)')}) WHERE x >= 0.25 AND x < 0.75 AND depth >= 1")
def f_zoom(spark, sf):
    return tree.zoom(_layout(spark, sf, "size"), 0.25, 0.5, 1).select("path", "depth", "x", "dx")


@query("w04_path_sums", """
    WITH p AS (SELECT doc_id, unnest([lang, source, CAST(doc_id AS VARCHAR)]) AS name, unnest([1, 2, 3]) AS depth FROM documents)
    SELECT doc_id, name, depth, CAST(sum(len(name)) OVER (PARTITION BY doc_id ORDER BY depth) AS BIGINT) AS acc FROM p""")
def w_path(spark, sf):
    rows = doc_leaves(spark, sf).select(F.col("path")[2].cast("bigint").alias("doc_id"), F.posexplode("path").alias("pos", "name"))
    rows = rows.select("doc_id", "name", (F.col("pos") + 1).alias("depth"), F.length("name").cast("bigint").alias("width"))
    return tree.path_sums(rows, ["doc_id"], "depth", "width").select("doc_id", "name", "depth", "acc")


@query("f08_labels", with_("cluster_topic", "SELECT 'Cluster ' || cluster AS cluster, 'Topic ' || topic AS topic, weight FROM cluster_topic"))
def f_labels(spark, sf):
    ct = c.cluster_topic(spark, sf)
    return ct.select(label("Cluster", F.col("cluster")).alias("cluster"), label("Topic", F.col("topic")).alias("topic"), "weight")


_P = "100.0 * v / r"


@query("f10_percent_text", f"""
    WITH s AS (SELECT source || '/' || lang AS path, CAST(sum(n_chars) AS DOUBLE) AS v FROM documents GROUP BY ALL),
    t AS (SELECT path, v, sum(v) OVER () AS r FROM s)
    SELECT path, CASE WHEN {_P} < 0.09995 THEN '< 0.1%' WHEN {_P} < 0.99995 THEN printf('%.3f', {_P}) || '%'
                 WHEN {_P} < 9.995 THEN printf('%.2f', {_P}) || '%' WHEN {_P} < 99.95 THEN printf('%.1f', {_P}) || '%'
                 ELSE printf('%.0f', {_P}) || '%' END AS percent FROM t""")
def f_percent(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.lit("t").alias("tree"), F.array(F.concat_ws("/", "source", "lang")).alias("path"), F.col("n_chars").cast("double").alias("size")
    )
    t = tree.node_percent(tree.tree_totals(docs)).where(F.col("depth") == 1)
    return t.select(F.col("path")[0].alias("path"), "percent")


@query("f16_ancestors", "SELECT doc_id, 'docs/' || lang AS above, source || '/' || doc_id AS below FROM documents")
def f_ancestors(spark, sf):
    d = doc_leaves(spark, sf).select(F.col("path")[2].cast("bigint").alias("doc_id"), F.concat(F.array("tree"), "path").alias("full"))
    chain = ancestors(F.col("full"))
    return d.select(
        "doc_id", F.concat_ws("/", F.col("full")[0], chain[0]).alias("above"),
        F.array_join(F.slice(chain, 2, 2), "/").alias("below"),
    )


_CHAIN = """
    WITH RECURSIVE l AS (SELECT doc_id AS node, CASE WHEN doc_id % 13 > 0 THEN doc_id - 1 - n_chars % 97 END AS parent FROM documents),
    n AS (SELECT node, parent FROM l UNION SELECT parent, NULL FROM l WHERE parent IS NOT NULL AND parent NOT IN (SELECT node FROM l)),
    a AS (SELECT node, parent AS ancestor, CAST(1 AS BIGINT) AS distance FROM n WHERE parent IS NOT NULL
          UNION ALL SELECT a.node, n.parent, distance + 1 FROM a JOIN n ON a.ancestor = n.node WHERE n.parent IS NOT NULL)
    SELECT node, ancestor, distance FROM a"""


def _links(spark, sf):
    """Every document answers an earlier one, or begins a thread."""
    parent = F.when(F.col("doc_id") % 13 > 0, F.col("doc_id") - 1 - F.col("n_chars") % 97)
    return table(spark, sf, "documents").select(F.col("doc_id").alias("node"), parent.alias("parent"))


@query("f16_ancestor_pairs", _CHAIN)
def f_ancestor_pairs(spark, sf):
    return ancestry.ancestor_pairs(_links(spark, sf))


@query("f16_cyclic_nodes", """
    WITH RECURSIVE l AS (SELECT event_id AS node, (event_id * 7 + CAST(user_id AS BIGINT)) % (SELECT count(*) + count(*) // 5 FROM events) AS parent FROM events),
    reached AS (SELECT DISTINCT parent AS node FROM l WHERE parent NOT IN (SELECT node FROM l)
                UNION SELECT l.node FROM reached r JOIN l ON l.parent = r.node)
    SELECT node FROM l WHERE node NOT IN (SELECT node FROM reached)""")
def f_cyclic(spark, sf):
    events = table(spark, sf, "events")
    n = events.agg(F.count(F.lit(1)).alias("n")).select((F.col("n") + F.call_function("div", F.col("n"), F.lit(5).cast("bigint"))).alias("n")).scalar()
    links = events.select(F.col("event_id").alias("node"), ((F.col("event_id") * 7 + F.col("user_id")) % n).alias("parent"))
    return ancestry.cyclic_nodes(links)


# ---------------------------------------------------------------- topic graph
_THRESHOLD = with_("sim", """
    , lo AS (SELECT i, j, sim FROM sim WHERE i > j)
    SELECT s.i, s.j, CASE WHEN s.i <> s.j AND l.sim < 0.1 THEN 0.0 ELSE s.sim END AS sim
    FROM sim s LEFT JOIN lo l ON l.i = greatest(s.i, s.j) AND l.j = least(s.i, s.j)""")


@query("p10_threshold", _THRESHOLD)
def p_threshold(spark, sf):
    return graph.threshold_symmetric(c.topic_sim(spark, sf), 0.1)


@query("o05_ranked_edges", with_("sim", "SELECT i, j, sim, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rank FROM sim"))
def o_edges(spark, sf):
    return graph.rank_edges(materialise(c.topic_sim(spark, sf), "sim")).select("i", "j", "sim", "rank")


@query("o05_group_sums", f"SELECT i, round(sum(sim), 6) + 0.0 AS value FROM ({_THRESHOLD}) GROUP BY i")
def o_groups(spark, sf):
    return rounded(graph.group_sums(p_threshold(spark, sf)), ["value"])


@query("k07_matrix_long", with_("ev", """
    SELECT CAST(x AS BIGINT) AS i, CAST(dense_rank() OVER (ORDER BY key) - 1 AS INTEGER) AS j, y AS sim FROM ev WHERE key IS NOT NULL"""))
def k_matrix(spark, sf):
    types = output.names_of(table(spark, sf, "events"), "event_type")
    wide = c.event_series(spark, sf).groupBy("x").pivot("key", types).agg(F.first("y"))
    return graph.matrix_long(wide, "x", types).where(F.col("sim").isNotNull())


@query("a17_field_set", """
    WITH k AS (SELECT unnest(json_keys(props)) AS field FROM events
               UNION ALL SELECT 'role_' || role FROM conversations)
    SELECT DISTINCT field FROM k""")
def a_fields(spark, sf):
    e = table(spark, sf, "events").select(F.from_json("props", "MAP<STRING, STRING>").alias("fields"))
    t = table(spark, sf, "conversations").select(F.create_map(F.concat(F.lit("role_"), "role"), F.lit("x")).alias("fields"))
    return graph.field_set(e.unionByName(t), "fields")


@query("a17_field_types", """
    WITH p AS (SELECT json_object('id', event_id, 'kind', event_type, event_type, CASE WHEN event_id % 2 = 0 THEN to_json(value) ELSE to_json('n/a') END) AS node FROM events
               UNION ALL SELECT json_object('turn', turn, 'role', role) FROM conversations),
    k AS (SELECT DISTINCT unnest(json_keys(node)) AS field FROM p)
    SELECT field, CASE WHEN field IN ('id', 'turn') THEN 'BIGINT' WHEN field IN ('kind', 'role') THEN 'STRING' ELSE 'VARIANT' END AS type FROM k""")
def a_field_types(spark, sf):
    e = table(spark, sf, "events")
    odd = F.when(F.col("event_id") % 2 == 0, F.to_json(F.create_map("event_type", "value"))).otherwise(F.to_json(F.create_map("event_type", F.lit("n/a"))))
    head = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind")))
    both = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(","), F.substring(odd, F.lit(2), F.length(odd)))
    t = table(spark, sf, "conversations").select(F.to_json(F.struct("turn", "role")).alias("node"))
    return graph.field_types(e.select(both.alias("node")).unionByName(t), "node")


@query("f17_link_width", """
    SELECT o_custkey AS source, o_orderstatus AS target, round(sqrt(count(*)), 9) + 0.0 AS width FROM orders GROUP BY ALL""")
def f_width(spark, sf):
    links = table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("value"))
    return links.select(F.col("o_custkey").alias("source"), F.col("o_orderstatus").alias("target"), rnd(link_width(F.col("value")), 9).alias("width"))


@query("j09_keyed_diff", with_("words", """
    SELECT coalesce(o.topic, n.topic - 1) AS topic, coalesce(o.word, n.word) AS word, o.weight AS old_value, n.weight AS new_value,
           CASE WHEN o.word IS NULL THEN 'added' WHEN n.word IS NULL THEN 'removed' ELSE 'kept' END AS status
    FROM words o FULL JOIN words n ON o.topic = n.topic - 1 AND o.word = n.word"""))
def j_diff(spark, sf):
    """Every topic against the next one."""
    old = materialise(c.source_words(spark, sf), "words")
    return joins.keyed_diff(old, old.withColumn("topic", F.col("topic") - 1), ["topic", "word"], "weight")
