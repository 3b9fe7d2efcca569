"""Reshaping for output: series, pairs, trees, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .scan import HOT_ROWS, row_number

POINTS = 100_000
NAMES = 1_000


def names_of(df: DataFrame, column: str, limit: int = NAMES) -> list:
    """Distinct non-null values of a column, in order, for what makes a column of each of them.

    At most ``limit`` reach the driver; with more the long form is the right one, and this is an error.
    """
    found = df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} values; use the long form")
    return [r[0] for r in found]


def unpivot(df: DataFrame, x: str, cols: list[str]) -> DataFrame:
    """Wide rows to ``(x, key, y)``."""
    return df.unpivot([x], cols, "key", "y")


def to_series(df: DataFrame, x: str, cols: list[str]) -> DataFrame:
    """One ``{key, values: [{x, y}..]}`` row per column of a binned table.

    The length of ``values`` is the number of bins. For series of unknown length use
    :func:`series_parts`.
    """
    long = unpivot(df, x, cols)
    points = F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col("y").alias("y"))))
    return long.groupBy("key").agg(points.alias("values"))


def series_parts(series: DataFrame, key: list[str], x: str, y: str, points: int = POINTS,
                 hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Series of any length as ordered parts of at most ``points`` points each."""
    numbered = row_number(series.select(*key, x, y), key, [x, y], "__i", hot_rows, start=0)
    part = F.call_function("div", F.col("__i"), F.lit(points).cast("bigint"))
    values = F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))))
    return numbered.withColumn("part", part).groupBy(*key, "part").agg(values.alias("values"))


def to_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """All ``[x, y]`` pairs of a binned table as one ordered array."""
    return df.agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).alias("pairs"))


def transpose(df: DataFrame, x: str, cols: list[str], values: list | None = None) -> DataFrame:
    """Bins by topics to topics by bins: long by default, wide for the given bin values."""
    long = unpivot(df, x, cols)
    return long if values is None else long.groupBy("key").pivot(x, values).agg(F.first("y"))


def tree_documents(rows: DataFrame) -> DataFrame:
    """One nested document per cluster from ``(cluster, topic, topic_rank, word, size, word_rank)``.

    Meant for cut trees of display size; :func:`tree_fragments` has no such limit.
    """
    leaf = F.when(F.col("word").isNotNull(), F.struct("word_rank", F.col("word").alias("name"), "size"))
    leaves = F.transform(
        F.array_sort(F.collect_list(leaf)), lambda w: F.struct(w["name"].alias("name"), w["size"].alias("size"))
    )
    topics = rows.groupBy("cluster", "topic", "topic_rank").agg(leaves.alias("children"))
    node = F.struct("topic_rank", F.concat(F.lit("Topic "), F.col("topic").cast("string")).alias("name"), "children")
    inner = F.transform(
        F.array_sort(F.collect_list(node)), lambda t: F.struct(t["name"].alias("name"), t["children"].alias("children"))
    )
    return topics.groupBy("cluster").agg(inner.alias("children")).select(
        F.concat(F.lit("Cluster "), F.col("cluster").cast("string")).alias("name"), "children"
    )


def nested_documents(leaves: DataFrame) -> DataFrame:
    """``(ord, document)``: one JSON document for each node below the root, from leaves ``(path, ord, size)`` of any depth.

    Levels are folded from the deepest up; a round joins the documents of the nodes of one level to
    those of their parents. A node's children are gathered in one row, as the format asks for; a
    subtree that is too large for a row can be written by :func:`tree_fragments`.
    """
    quoted = F.to_json(F.struct(F.element_at("path", -1).alias("name")))
    body = F.when(F.col("size").isNull(), quoted).otherwise(F.to_json(F.struct(F.element_at("path", -1).alias("name"), "size")))
    nodes = materialise(leaves.select("path", "ord", body.alias("document")), "leaves")
    depth = nodes.agg(F.max(F.size("ord"))).first()[0] or 0
    for d in range(depth, 1, -1):
        deep = nodes.where(F.size("ord") == d)
        up = F.slice("ord", 1, d - 1)
        child = F.struct(F.element_at("ord", -1).alias("at"), "document")
        met = deep.groupBy(up.alias("__ord")).agg(F.array_sort(F.collect_list(child)).alias("c"), F.min(F.slice("path", 1, d - 1)).alias("__path"))
        head = F.to_json(F.struct(F.element_at("__path", -1).alias("name")))
        text = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"children":['), F.array_join(F.transform("c", lambda x: x["document"]), ","), F.lit("]}"))
        folded = met.select(F.col("__path").alias("path"), F.col("__ord").alias("ord"), text.alias("document"))
        nodes = materialise(nodes.where(F.size("ord") < d).unionByName(folded), "folded")
    return nodes.select("ord", "document")


def tree_fragments(rows: DataFrame, root: str) -> DataFrame:
    """The nested document as ordered pieces of text, one per leaf.

    Pieces sorted by ``cluster, topic_rank, word_rank`` and joined give one valid document. Each
    piece only needs to know whether it opens or closes a topic, a cluster or the root, so no
    task ever holds more than a row, whatever the size of the tree.
    """
    per_topic = rows.groupBy("cluster", "topic").agg(F.max("word_rank").alias("last_word"))
    per_cluster = rows.groupBy("cluster").agg(F.max("topic_rank").alias("last_topic"))
    ends = per_cluster.select(F.struct(F.min("cluster").alias("a"), F.max("cluster").alias("z"))).scalar()
    d = rows.join(per_topic, ["cluster", "topic"]).join(per_cluster, "cluster")
    opens_topic = F.coalesce(F.col("word_rank") == 1, F.lit(True))
    closes_topic = F.coalesce(F.col("word_rank") == F.col("last_word"), F.lit(True))
    opens_cluster = opens_topic & (F.col("topic_rank") == 1)
    closes_cluster = closes_topic & (F.col("topic_rank") == F.col("last_topic"))
    opens_root = opens_cluster & (F.col("cluster") == ends["a"])
    closes_root = closes_cluster & (F.col("cluster") == ends["z"])

    def when(c, text):
        return F.when(c, text).otherwise(F.lit(""))

    def named(prefix, col):
        quoted = F.to_json(F.struct(F.concat(F.lit(prefix), F.col(col).cast("string")).alias("name")))
        return F.concat(F.substring(quoted, F.lit(1), F.length(quoted) - 1), F.lit(',"children":['))

    top = F.to_json(F.struct(F.lit(root).alias("name")))
    text = F.concat(
        when(opens_root, F.concat(F.substring(top, F.lit(1), F.length(top) - 1), F.lit(',"children":['))),
        when(opens_cluster & ~opens_root, F.lit(",")),
        when(opens_cluster, named("Cluster ", "cluster")),
        when(opens_topic & ~opens_cluster, F.lit(",")),
        when(opens_topic, named("Topic ", "topic")),
        when(~opens_topic, F.lit(",")),
        F.coalesce(F.to_json(F.when(F.col("word").isNotNull(), F.struct(F.col("word").alias("name"), "size"))), F.lit("")),
        when(closes_topic, F.lit("]}")),
        when(closes_cluster, F.lit("]}")),
        when(closes_root, F.lit("]}")),
    )
    return d.select("cluster", "topic_rank", "word_rank", text.alias("fragment"))


def write_fragments(fragments: DataFrame, path: str) -> None:
    """Range-sorted text files; joined in file order they are the document."""
    fragments.orderBy("cluster", "topic_rank", "word_rank").select("fragment").write.text(path, lineSep="\n")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row."""
    df.write.json(path)


def peek(df: DataFrame, n: int = 20) -> DataFrame:
    """At most ``n`` rows to look at."""
    return df.limit(n)
