"""Document fingerprints: one-permutation MinHash in built-in expressions only.

Each five-word shingle is hashed once. The first bits of the hash name one of ``BINS`` bins, and the
smallest hash of a bin is its value. An empty bin ``i`` takes the value of the non-empty bin ``j``
whose hash of ``(i, j)`` is smallest, which is the first non-empty bin met along a random order
fixed for ``i``: optimal densification, the same for every document. Only the low ``BITS`` bits of
each value are kept, as hexadecimal text. Unrelated values agree by chance with probability
``2^-BITS``; :func:`likeness` takes that out.

A text with fewer words than a shingle is one shingle of all its words. A text without words (null,
empty, spaces) has an empty fingerprint: alike (1.0) to another empty one, unlike (0.0) any other.
Fingerprints depend on the text alone, so repeated rows repeat; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, words

SHINGLE = 5
BINS = 128  # a power of two
BITS = 8
IDS_PER_SLICE = 200_000


def fingerprints(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the fingerprint of the non-null column ``text`` as hexadecimal column ``name``."""
    w, n, h, b = f"__{name}_w", f"__{name}_n", f"__{name}_h", f"__{name}_b"
    shift = 64 - (BINS - 1).bit_length()
    bin_of = lambda x: F.shiftrightunsigned(x, shift)
    width = F.least(F.col(n), F.lit(SHINGLE))
    shingles = F.when(
        F.col(n) >= SHINGLE,
        F.transform(F.sequence(F.lit(0), F.col(n) - SHINGLE), lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(SHINGLE)])),
    ).when(width > 0, F.array(F.xxhash64(F.concat_ws(" ", F.col(w))))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(w, words(F.col(text))).withColumn(n, F.size(w)).withColumn(h, shingles)
    # the bin is the top of an unsigned hash: in signed order bins still stand together
    df = df.withColumn(h, F.sort_array(h))
    smallest = F.filter(F.col(h), lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col(h), i - 1))))
    df = df.withColumn(b, smallest)
    best = lambda i: F.array_min(
        F.transform(F.col(b), lambda x: F.struct(F.hash(i, bin_of(x).cast("int")).alias("r"), x.alias("v")))
    )["v"]
    own, filled = f"__{name}_o", f"__{name}_f"
    # slots in the order of the sorted minima: bins of negative hashes (the upper half) come first
    slots = F.transform(F.col(b), lambda x: bin_of(x).cast("int"))
    df = df.withColumn(own, slots)
    at = lambda i: F.array_position(F.col(own), i)
    value = lambda i: F.when(at(i) > 0, F.get(F.col(b), at(i).cast("int") - 1)).otherwise(best(i))
    low = lambda v: F.lpad(F.lower(F.hex(v.bitwiseAND((1 << BITS) - 1))), BITS // 4, "0")
    df = df.withColumn(filled, F.when(F.size(b) > 0, F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), value)))
    return df.withColumn(name, F.coalesce(F.concat_ws("", F.transform(F.col(filled), low)), F.lit(""))).drop(w, n, h, b, own, filled)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets of two fingerprints, 0 to 1."""
    step = BITS // 4
    same = F.aggregate(
        F.sequence(F.lit(0), F.lit(BINS - 1)), F.lit(0),
        lambda acc, i: acc + F.when(F.substr(a, i * step + 1, F.lit(step)) == F.substr(b, i * step + 1, F.lit(step)), 1).otherwise(0),
    )
    chance = 2.0**-BITS
    corrected = F.greatest((same / F.lit(float(BINS)) - chance) / (1 - chance), F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(corrected)


def ring(ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, next_id)``: each distinct id with the next larger one, the last with the first.

    Ids are dealt out by range and sorted range by range; the ranges' first ids, one row for each
    range, close the gaps. Null ids are left out.
    """
    distinct = ids.select(F.col(id_col).alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct()
    distinct = stored(distinct, "ids")
    n = max(1, -(-distinct.count() // IDS_PER_SLICE))
    ranged = stored(distinct.repartitionByRange(n, "doc_id").withColumn("part", F.spark_partition_id()), "id-ranges")
    heads = ranged.groupBy("part").agg(F.min("doc_id").alias("head"))
    by_part = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("head").over(by_part), F.min("head").over(Window.partitionBy())).alias("after"))
    inside = Window.partitionBy("part").orderBy("doc_id")
    return ranged.select("part", "doc_id", F.lead("doc_id").over(inside).alias("following")).join(heads, "part").select(
        "doc_id", F.coalesce("following", "after").alias("next_id")
    )


def with_edits(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, n_chars, next_id, edited)``: the last quarter of a text gives way to as much of
    the beginning of the next document's text. Of rows that share an id, the smallest text is the one
    that others continue with; a row without an id keeps the rest of its text alone.

    Both joins that need texts ask for the same rows by the same key, so the texts are shuffled once.
    """
    following = stored(ring(docs), "ring")
    named = docs.where(F.col("doc_id").isNotNull())
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    wanted = named.groupBy("doc_id").agg(F.max(F.floor(F.char_length("text") / 4)).cast("int").alias("most"))
    heads = following.join(wanted, "doc_id").groupBy("next_id").agg(F.max("most").alias("most"))
    starts = named
    if following.count() != named.count():
        starts = named.groupBy("doc_id").agg(F.min("text").alias("text"))
    firsts = starts.join(heads, starts["doc_id"] == heads["next_id"]).select(
        "next_id", F.substring(F.col("text"), F.lit(1), F.col("most")).alias("head")
    )
    given = following.join(firsts, "next_id").withColumnRenamed("doc_id", "of")
    placed = named.join(given, named["doc_id"] == given["of"]).drop("of")
    alone = docs.where(F.col("doc_id").isNull()).withColumns({"next_id": F.lit(None).cast("bigint"), "head": F.lit("")})
    sized = placed.select("doc_id", "text", "next_id", "head").union(alone.select("doc_id", "text", "next_id", "head")).withColumn(
        "n_chars", F.char_length("text").cast("bigint")
    )
    return sized.withColumn(
        "edited",
        F.concat(
            F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - quarter).cast("int")),
            F.substring(F.col("head"), F.lit(1), quarter),
        ),
    ).drop("head")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and edited texts of ``docs`` (``doc_id``, non-null ``text``), and
    how alike each is to its edited text and to the next document."""
    edited = with_edits(docs)
    marked = fingerprints(fingerprints(edited, "text", "fingerprint"), "edited", "edited_fingerprint")
    marks = stored(
        marked.select("doc_id", "next_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint"),
        "fingerprints",
    )
    by_next = marks.groupBy(F.col("doc_id").alias("next_id")).agg(F.min_by("fingerprint", "n_chars").alias("next_mark"))
    return marks.join(by_next, "next_id", "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        F.coalesce(likeness(F.col("fingerprint"), F.col("next_mark")), F.lit(0.0)).alias("near_next"),
    )
