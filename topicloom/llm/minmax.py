"""Near-duplicates by min-max hashing: both ends of each permutation, banded, then confirmed exactly.

A document's set holds the distinct shingles of its lower-cased words (A-Z only); with fewer words
than a shingle, the whole sequence is one. ``PERMUTATIONS`` hash evaluations per shingle give the
smallest and the largest value of each, an unbiased signature of twice as many values. Bands take
the two ends of ``ROWS / 2`` permutations. Sets of similarity ``s`` share no band with probability
``(1 - s^ROWS)^BANDS``, 5e-7 at 0.8.

1. Copies (equal sets) become one class by a 128-bit digest; from here on a class is one row, known
   by its smallest document id.
2. Classes that share a band are candidates. Instead of all pairs of a bucket, each member meets the
   centers of its buckets, and is paired with the one it shares most buckets with, in a few rounds
   with other centers; a round's confirmed links merge components, and only buckets with several
   components go on.
3. What is left after these rounds are members of buckets with several components. Their shingles are
   put in order, the rarest among them first. Similar sets must share a shingle near their beginnings,
   and early enough for the shingles after it to reach the overlap that is asked for (prefix and
   position filter). Only such pairs of different components go on. No link is lost by it, and copies
   with edits of their own that fall short of the similarity form no pairs, however many there are.
4. A pair is confirmed on the full sets of both texts.

A null, empty or blank text has an empty set and links with nothing. Rows that share an id stand
together: the smallest text is compared for all. A row without an id is not compared; its component
is null and it is kept. An empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, by_rows, only_memory, small, split_bytes, stored
from .graph import components

BANDS, ROWS = 48, 6
PERMUTATIONS = BANDS * ROWS // 2
STARS = 4
BITS = 1024  # of the bitmaps that bound an overlap
TOGETHER = 500  # pairs of one document that are confirmed in one place
_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, PERMUTATIONS, np.uint64)
_BAND = _RNG.integers(0, 1 << 63, (ROWS, BANDS), np.uint64) * np.uint64(2) + np.uint64(1)
_WORDS = WordHash()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words = split_bytes(text, lower=True)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(width, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(0xD6E8FEB86659FD93) + h[i:len(h) - k + 1 + i])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """``[min of each permutation, max of each permutation]`` as rows."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), 2048):
        h = shingles[at:at + 2048] * _A[:, None] + _B[:, None]
        np.minimum(low, h.min(1), out=low)
        np.maximum(high, h.max(1), out=high)
    return np.stack([low, high])


def band_keys(ends: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, from both ends of ``ROWS / 2`` permutations; different bands never share keys."""
    rows = ends.reshape(2, ROWS // 2, BANDS).reshape(ROWS, BANDS)
    key = np.arange(BANDS, dtype=np.uint64)
    for row, factor in zip(rows, _BAND, strict=True):
        key = _mix((key + row) * factor)
    return key


def _sign(width: int):
    def run(batches):
        only_memory(_WORDS)
        for part in by_rows(batches):
            sizes, digests, bands = [], [], []
            for text in part.column(1).to_pylist():
                s = shingle_set(text, width)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                bands.append(band_keys(signature(s)) if len(s) else np.zeros(0, np.uint64))
            offsets = np.concatenate(([0], np.cumsum([len(b) for b in bands]))).astype(np.int32)
            values = np.concatenate(bands).view(np.int64) if bands else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                names=["doc_id", "n", "digest", "bands"],
            )

    return run


def _confirm(width: int, percent: int):
    """Rows ``(a, part, b, text)``, sorted, so that the text of ``a`` (``b`` null) comes before those it is compared with."""

    def run(batches):
        only_memory(_WORDS)
        head = None
        for part in by_rows(batches, 64):
            keep = []
            for b, text in zip(part.column("b").to_pylist(), part.column("text").to_pylist(), strict=True):
                s = shingle_set(text, width)
                if b is None:
                    head = s
                    keep.append(False)
                    continue
                common = len(np.intersect1d(head, s, assume_unique=True))
                keep.append(100 * common >= percent * (len(head) + len(s) - common))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of ids whose full sets are similar enough.

    The pairs of one ``a`` are dealt out in parts of about ``TOGETHER``. A part gets the text of ``a``
    once and each ``b``'s text, so texts travel about once per pair and no part is large.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("parts"))
    dealt = stored(pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b"), "dealt")
    heads = stored(dealt.select("a", "part").distinct(), "heads")
    first = docs.join(small(heads), docs["doc_id"] == heads["a"]).select("a", "part", F.lit(None).cast("bigint").alias("b"), "text")
    others = docs.join(small(dealt), docs["doc_id"] == dealt["b"]).select("a", "part", "b", "text")
    met = first.union(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return met.mapInArrow(_confirm(width, percent), "a bigint, b bigint")


def _meet(members: DataFrame, others: DataFrame, percent: int) -> DataFrame:
    """Rows of members beside the others of their bucket that are in different components and near enough in size."""
    near = 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")
    return members.join(others, "bucket").where(near & (F.col("label") != F.col("label2")))


def _likeliest(met: DataFrame) -> DataFrame:
    """Of the centers that a member meets, the one it shares most buckets with: one pair per member."""
    shares = met.select("node", "node2").repartition("node").groupBy("node", "node2").agg(F.count(F.lit(1)).alias("shared"))
    best = shares.groupBy("node").agg(F.max(F.struct("shared", F.xxhash64("node2").alias("turn"), "node2")).alias("best"))
    return best.select(F.col("best.node2").alias("a"), F.col("node").alias("b"))


def parity(shingles: np.ndarray) -> np.ndarray:
    """Bitmap of ``BITS`` places: whether an odd number of shingles falls on each.

    Two bitmaps differ in at most as many places as shingles stand in one set alone.
    """
    counts = np.bincount((shingles >> np.uint64(20)) % np.uint64(BITS), minlength=BITS)
    return np.packbits((counts & 1).astype(np.uint8)).view("<i8")


def _sets(width: int):
    def run(batches):
        only_memory(_WORDS)
        for part in by_rows(batches):
            sets = [shingle_set(t, width) for t in part.column(1).to_pylist()]
            bits = [parity(x).tolist() for x in sets]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(bits, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["node", "bits", "shingles"]
            )

    return run


def prefix_pairs(texts: DataFrame, open_: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of open ``(node, n, label)`` with different labels whose sets can be similar enough.

    With sizes ``n1 <= n2`` the overlap must be at least ``percent * (n1 + n2) / (100 + percent)``, so the
    smaller set has a common shingle among its first ``n1 - 2 * percent * n1 / (100 + percent) + 1``, and the
    larger one among its first ``n2 - percent * n2 / 100 + 1``. A shingle that no other open set has takes
    a place there without a row of its own. What stands in one set alone is at least the places in
    which the sets' bitmaps differ, which bounds the overlap before any text moves.
    """
    held = texts.join(small(open_.select(F.col("node").alias("__open"))), F.col("doc_id") == F.col("__open")).select(F.col("doc_id").alias("node"), "text")
    sets = stored(held.mapInArrow(_sets(width), "node bigint, bits array<bigint>, shingles array<bigint>"), "open-sets")
    each = sets.select("node", F.explode("shingles").alias("shingle"))
    common = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1").withColumnRenamed("shingle", "__s")
    listed = each.join(common, F.col("shingle") == F.col("__s")).groupBy(F.col("node").alias("__node")).agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("rare"))
    met = listed.join(open_, F.col("__node") == F.col("node")).join(sets.select(F.col("node").alias("__bits_of"), "bits"), F.col("__node") == F.col("__bits_of"))
    alone = F.col("n") - F.size("rare")
    index = F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent)) + 1
    probe = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1
    begin = F.slice("rare", F.lit(1), F.greatest(F.lit(0), probe - alone).cast("int"))
    rows = met.withColumns({"index": index, "alone": alone}).where(probe > alone).select("node", "n", "label", "bits", "index", "alone", F.posexplode(begin).alias("__i", "x"))
    rows = stored(rows.select("node", "n", "label", "bits", (F.col("alone") + F.col("__i")).alias("pos"), "index", F.col("x.shingle").alias("shingle")), "prefixes")
    first = rows.where(F.col("pos") < F.col("index")).drop("index")
    second = rows.select("shingle", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "label", "pos", "bits")])
    larger = (F.col("n2") > F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("node2") > F.col("node")))
    within = (100 + percent) * F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")) >= percent * (F.col("n") + F.col("n2"))
    differ = F.aggregate(F.zip_with("bits", "bits2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    within = within & ((100 + percent) * (F.col("n") + F.col("n2") - differ) >= 2 * percent * (F.col("n") + F.col("n2")))
    near = first.join(second, (first["shingle"] == second["shingle"]) & larger & (F.col("label") != F.col("label2")) & within)
    return near.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, class_id, component_id, kept)`` for each row of ``docs`` (``doc_id``, non-null ``text``)."""
    signed = stored(docs.mapInArrow(_sign(width), "doc_id bigint, n bigint, digest binary, bands array<bigint>"), "signatures")
    named = docs.where(F.col("doc_id").isNotNull())
    comparable = signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    if not signed.groupBy("doc_id").count().where("count > 1").isEmpty():
        named = stored(named.groupBy("doc_id").agg(F.min("text").alias("text")), "one-text")
        comparable = stored(named.mapInArrow(_sign(width), "doc_id bigint, n bigint, digest binary, bands array<bigint>"), "signatures").where("n > 0")
    classes = stored(
        comparable.groupBy("digest").agg(F.min("doc_id").alias("node"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands")), "classes"
    )
    members = classes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket")
    members = stored(members.join(shared, "bucket"), "buckets")
    candidates = stored(members.select(F.col("node").alias("at")).distinct(), "candidates")
    candidates = stored(named.join(small(candidates), F.col("doc_id") == F.col("at"), "left_semi"), "candidate-texts")

    tested = links = None
    labels = None
    for round_ in range(STARS + 1):
        if labels is None:
            labelled = members.withColumn("label", F.col("node"))
        else:
            named_labels = small(labels.withColumnRenamed("node", "at"))
            labelled = members.join(named_labels, members["node"] == F.col("at"), "left").select(
                "bucket", "node", "n", F.coalesce("label", "node").alias("label")
            )
        if round_ < STARS:
            turn = F.xxhash64("node", F.lit(round_))
            centers = labelled.groupBy("bucket").agg(
                F.min(F.struct(turn.alias("turn"), "node", "n", "label")).alias("center"), F.min("label").alias("lo"), F.max("label").alias("hi")
            ).where("lo < hi").select("bucket", *[F.col(f"center.{c}").alias(f"{c}2") for c in ("node", "n", "label")])
            pairs = _likeliest(_meet(labelled, centers, percent))
        else:
            labels_of = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
            open_ = stored(labelled.join(labels_of, "bucket").select("node", "n", "label").distinct(), "open")
            if open_.isEmpty():
                continue
            pairs = prefix_pairs(candidates, open_, width, percent)
        if tested is not None:
            ordered = tested.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct()
            pairs = pairs.join(ordered, (F.least("a", "b") == F.col("low")) & (F.greatest("a", "b") == F.col("high")), "left_anti")
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            continue
        found = stored(confirm(pairs, candidates, width, percent), "confirmed")
        tested = pairs if tested is None else tested.union(pairs)
        links = found if links is None else links.union(found)
        if not found.isEmpty():
            labels = components(links)

    classes_of = comparable.join(classes.select("digest", "node"), "digest").select(F.col("doc_id").alias("id"), F.col("node").alias("class_id"))
    if labels is not None:
        at = labels.withColumnRenamed("node", "at")
        classes_of = classes_of.join(at, F.col("class_id") == F.col("at"), "left").drop("at")
    else:
        classes_of = classes_of.withColumn("label", F.lit(None).cast("bigint"))
    classes_of = classes_of.select("id", "class_id", F.coalesce("label", "class_id").alias("component_id")).dropDuplicates(["id"])
    rows = signed.select("doc_id", F.col("n").alias("n_shingles"))
    out = rows.join(classes_of, rows["doc_id"] == classes_of["id"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
