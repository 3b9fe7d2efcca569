"""The given tables read as a topic-model corpus, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import epoch_seconds
from ..operators.joins import with_metadata
from ..operators.scan import row_number
from ..operators.shares import row_shares
from ..session import materialise
from .registry import table

LO, HI, BINS, TOPICS = 1704067200, 1706659200, 200, 64
DAY0 = LO // 86400
TYPES = ["click", "error", "purchase", "signup", "view"]
FLAGS = ["A", "N", "R"]


# ---------------------------------------------------------------- documents and weights
def doc_topic(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, weights``: absolute vector entries divided by their sum; all ``TOPICS`` entries of a vector."""
    entries = F.transform("embedding", lambda v: F.abs(v.cast("double")))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), row_shares(entries).alias("weights"))


def times(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), "ts")


def thread(spark: SparkSession, sf: str, event: Column) -> Column:
    """The vector of an event's thread: every vector has events, and every event a vector."""
    return event % table(spark, sf, "embeddings").agg(F.count(F.lit(1))).scalar()


def doc_topic_time(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a message ``doc_id, weights, ts`` with the weights of its thread."""
    messages = times(spark, sf).withColumn("thread", thread(spark, sf, F.col("doc_id")))
    weights = doc_topic(spark, sf).withColumnRenamed("doc_id", "thread")
    return with_metadata(weights, messages, "thread")


def meta(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a version of a document, with its time."""
    count = table(spark, sf, "documents").agg(F.count(F.lit(1))).scalar()
    versions = times(spark, sf).select(F.col("doc_id").alias("version"), (F.col("doc_id") % count).alias("doc_id"), "ts")
    return with_metadata(table(spark, sf, "documents").select("doc_id", "lang", "source"), versions)


def mail(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as messages ``id, date, from, to, subject``; ``to`` holds the roles met."""
    talks = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.min_by("role", "turn").alias("from"),
        F.array_sort(F.collect_set("role")).alias("to"),
        F.min_by("text", "turn").alias("subject"),
    )
    at = times(spark, sf).select(F.col("doc_id").alias("conv_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"))
    return talks.join(at, "conv_id").select(F.col("conv_id").alias("id"), "date", "from", "to", "subject")


# ---------------------------------------------------------------- words, topics, clusters
def source_words(spark: SparkSession, sf: str) -> DataFrame:
    """``topic, word, weight``: word counts per document source.

    Written once: the table is read several times by what follows, the texts only here.
    """
    docs = table(spark, sf, "documents")
    tokens = docs.select(
        F.substring("source", F.lit(4), F.length("source")).cast("bigint").alias("topic"),
        F.explode(F.split(F.lower("text"), r"\s+")).alias("word"),
    )
    counts = tokens.where(F.col("word") != "").groupBy("topic", "word").agg(F.count(F.lit(1)).alias("weight"))
    return materialise(counts, "words")


def vocab(words: DataFrame) -> DataFrame:
    """``word_id, word, count`` with ids by falling count."""
    counts = materialise(words.groupBy("word").agg(F.sum("weight").alias("count")), "word-counts")
    ids = row_number(counts, [], [-F.col("count"), "word"], "word_id", start=0)
    return materialise(ids.select("word_id", "word", "count"), "vocab")


def topic_word(words: DataFrame, terms: DataFrame) -> DataFrame:
    return materialise(words.join(terms.select("word", "word_id"), "word").select("topic", "word_id", "weight"), "topic-word")


def cluster_topic(spark: SparkSession, sf: str) -> DataFrame:
    """``cluster, topic, weight``: documents per language and source."""
    docs = table(spark, sf, "documents")
    topic = F.substring("source", F.lit(4), F.length("source")).cast("bigint").alias("topic")
    return docs.groupBy(F.col("lang").alias("cluster"), topic).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def topic_sim(spark: SparkSession, sf: str) -> DataFrame:
    """``i, j, sim``: cosine of the mean vectors of two labels, one row per cell of the matrix."""
    cells = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("d", "v"))
    # read four times below, the vectors only here
    mean = materialise(cells.groupBy("label", "d").agg(F.avg(F.col("v").cast("double")).alias("m")), "means")
    norm = mean.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("n"))
    unit = mean.join(norm, "label").select("label", "d", (F.col("m") / F.col("n")).alias("u"))
    a = unit.select(F.col("label").alias("i"), "d", F.col("u").alias("a"))
    b = unit.select(F.col("label").alias("j"), "d", F.col("u").alias("b"))
    dots = a.join(b, "d").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("sim"))
    return dots.select("i", "j", (F.round("sim", 9) + F.lit(0.0)).alias("sim"))


# ---------------------------------------------------------------- series
def _position(col: str, names: list[str]):
    return (F.array_position(F.array(*[F.lit(n) for n in names]), F.col(col)) - 1).cast("int")


def day(ts: str):
    return F.unix_date(F.col(ts).cast("date")).cast("bigint")


def event_series(spark: SparkSession, sf: str, value=None) -> DataFrame:
    """Value per event type and day."""
    y = F.sum("value") if value is None else value
    return (
        table(spark, sf, "events")
        .groupBy(F.lit("events").alias("chart"), F.col("event_type").alias("key"), day("ts").alias("x"))
        .agg(F.round(y, 2).alias("y"))
        .select("chart", "key", _position("key", TYPES).alias("series_idx"), "x", "y")
    )


def item_series(spark: SparkSession, sf: str) -> DataFrame:
    """Price per return flag and month."""
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).cast("bigint")
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.lit("items").alias("chart"), F.col("l_returnflag").alias("key"), month.alias("x"))
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("y"))
        .select("chart", "key", _position("key", FLAGS).alias("series_idx"), "x", "y")
    )


def event_points(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a point ``chart, key, idx, x, y`` with x in whole seconds."""
    return table(spark, sf, "events").select(
        F.lit("events").alias("chart"), F.col("event_type").alias("key"), F.col("event_id").alias("idx"),
        epoch_seconds(F.col("ts")).alias("x"), F.col("value").alias("y"),
    )


def gappy_series(spark: SparkSession, sf: str) -> DataFrame:
    """Event series with some values missing."""
    gap = F.col("x") % (F.col("series_idx") + 5) == 0
    return event_series(spark, sf).withColumn("y", F.when(~gap, F.col("y")))


def doc_probes(spark: SparkSession, sf: str) -> DataFrame:
    """One probe per document: an event type and a second of the month."""
    docs = table(spark, sf, "documents")
    kind = F.get(F.array(*[F.lit(t) for t in TYPES]), (F.col("doc_id") % 5).cast("int"))
    at = F.lit(LO) + (F.col("n_chars") * 7919 + F.col("doc_id") * 104729) % (HI - LO)
    return docs.select(F.col("doc_id").alias("probe_id"), kind.alias("key"), at.alias("at"), "n_chars")


# ---------------------------------------------------------------- the same as SQL
_TYPES = "['click', 'error', 'purchase', 'signup', 'view']"
CTE = {
    "doc_topic": """
        dt0 AS (SELECT vec_id AS doc_id, list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE))) AS a
                FROM embeddings),
        doc_topic AS (SELECT doc_id, list_transform(a, lambda v: v / list_sum(a)) AS weights FROM dt0)""",
    "dtt": """
        dtt AS (SELECT e.event_id AS doc_id, d.weights, e.ts, epoch_us(e.ts) // 1000000 AS t
                FROM doc_topic d JOIN events e ON d.doc_id = e.event_id % (SELECT count(*) FROM embeddings))""",
    "meta": """
        meta AS (SELECT d.doc_id, e.event_id AS version, d.lang, d.source, e.ts, epoch_us(e.ts) // 1000000 AS t
                 FROM documents d JOIN events e ON d.doc_id = e.event_id % (SELECT count(*) FROM documents))""",
    "borders": f"""
        borders AS (SELECT {LO} + (k * {HI - LO}) // {BINS} AS bin FROM range({BINS}) r(k))""",
    "binned": f"""
        binned AS (SELECT d.*, b.bin FROM dtt d ASOF JOIN borders b ON d.t >= b.bin WHERE d.t > {LO} AND d.t < {HI})""",
    "mail": """
        mail AS (SELECT c.conv_id AS id, strftime(any_value(e.ts), '%Y-%m-%dT%H:%M:%SZ') AS date,
                        any_value(epoch_us(e.ts) // 1000000) AS t, arg_min(c.role, c.turn) AS "from",
                        list_sort(list(DISTINCT c.role)) AS "to", arg_min(c.text, c.turn) AS subject
                 FROM conversations c JOIN events e ON e.event_id = c.conv_id GROUP BY c.conv_id)""",
    "words": r"""
        tokens AS (SELECT CAST(substr(source, 4) AS BIGINT) AS topic,
                          unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM documents),
        words AS MATERIALIZED (SELECT topic, word, count(*) AS weight FROM tokens WHERE word <> '' GROUP BY topic, word)""",
    "vocab": """
        vocab AS MATERIALIZED (SELECT row_number() OVER (ORDER BY count DESC, word) - 1 AS word_id, word, count
                  FROM (SELECT word, CAST(sum(weight) AS BIGINT) AS count FROM words GROUP BY word))""",
    "topic_word": """
        topic_word AS MATERIALIZED (SELECT topic, word_id, weight FROM words JOIN vocab USING (word))""",
    "word_cut": """
        ws AS (SELECT topic, word_id, weight / sum(weight) OVER (PARTITION BY topic) AS share FROM topic_word),
        wc AS (SELECT *, sum(share) OVER w AS cum, row_number() OVER w AS rank FROM ws
               WINDOW w AS (PARTITION BY topic ORDER BY share DESC, word_id DESC ROWS UNBOUNDED PRECEDING)),
        word_cut AS MATERIALIZED (SELECT * FROM wc WHERE round(cum, 12) < 0.2)""",
    "cluster_topic": """
        cluster_topic AS (SELECT lang AS cluster, CAST(substr(source, 4) AS BIGINT) AS topic,
                                 CAST(count(*) AS DOUBLE) AS weight FROM documents GROUP BY ALL)""",
    "topic_cut": """
        cs AS (SELECT cluster, topic, weight / sum(weight) OVER (PARTITION BY cluster) AS share FROM cluster_topic),
        cc AS (SELECT *, sum(share) OVER w AS cum, row_number() OVER w AS rank FROM cs
               WINDOW w AS (PARTITION BY cluster ORDER BY share DESC, topic DESC ROWS UNBOUNDED PRECEDING)),
        topic_cut AS (SELECT * FROM cc WHERE round(cum, 12) < 0.4)""",
    "tree": """
        tree AS (SELECT t.cluster, t.topic, t.share AS topic_share, t.rank AS topic_rank,
                        w.word_id, v.word, w.share AS size, w.rank AS word_rank
                 FROM topic_cut t LEFT JOIN word_cut w USING (topic) LEFT JOIN vocab v USING (word_id))""",
    "sim": """
        cells AS (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS d FROM embeddings),
        mean AS (SELECT label, d, avg(CAST(v AS DOUBLE)) AS m FROM cells GROUP BY label, d),
        unit AS (SELECT label, d, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS u FROM mean),
        sim AS (SELECT a.label AS i, b.label AS j, round(sum(a.u * b.u), 9) + 0.0 AS sim
                FROM unit a JOIN unit b USING (d) GROUP BY a.label, b.label)""",
    "ev": f"""
        ev AS (SELECT 'events' AS chart, event_type AS key,
                      CAST(list_position({_TYPES}, event_type) - 1 AS INTEGER) AS series_idx,
                      epoch_us(ts) // 86400000000 AS x, round(sum(value), 2) AS y FROM events GROUP BY ALL)""",
    "evi": """
        evi AS (SELECT *, row_number() OVER (PARTITION BY chart, key ORDER BY x) - 1 AS idx FROM ev)""",
    "li": """
        li AS (SELECT 'items' AS chart, l_returnflag AS key,
                      CAST(list_position(['A', 'N', 'R'], l_returnflag) - 1 AS INTEGER) AS series_idx,
                      CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS BIGINT) AS x,
                      round(sum(l_extendedprice), 2) AS y FROM lineitem GROUP BY ALL)""",
    "pts": """
        pts AS (SELECT 'events' AS chart, event_type AS key, event_id AS idx,
                       epoch_us(ts) // 1000000 AS x, value AS y FROM events)""",
    "gappy": """
        gappy AS (SELECT * REPLACE (CASE WHEN x % (series_idx + 5) <> 0 THEN y END AS y) FROM ev)""",
    "probes": f"""
        probes AS (SELECT doc_id AS probe_id, {_TYPES}[CAST(doc_id % 5 AS INTEGER) + 1] AS key,
                          {LO} + (n_chars * 7919 + doc_id * 104729) % {HI - LO} AS at, n_chars FROM documents)""",
}


def with_(names: str, body: str) -> str:
    """SQL of ``body`` over the named pieces, in the given order."""
    return "WITH " + ",".join(CTE[n] for n in names.split()) + body
