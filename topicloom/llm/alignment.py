"""Line dedup by pairwise alignment: common blocks go from the later of two overlapping documents.

1. Lines are compared by the 64-bit hash of their trimmed text. From each line with words, and back
   from it, the shortest run of lines with at least ``BLOCK_WORDS`` words gives a key. Documents with a
   common block of so many words share such a key, and each line of the block lies in the run of one.
2. Each document is paired with the first one that holds a key of it. So the pairs are at most as many
   as keys, also for a block that very many documents hold, and each block meets a document that has it.
3. Each pair is aligned by patience diff over the lines of the runs that both hold: lines that are
   unique on both sides and keep their order are anchors, equal lines next to them are taken along, and
   the gaps are aligned the same way. Runs that cross those are aligned in a further round of the pair.
4. Aligned blocks of at least ``BLOCK_WORDS`` words are deleted from the document with the larger id. In
   the end no document holds a block that an earlier one has.

A null or empty text has no line that counts and stays as it is. Rows that share an id are one
document and are not compared with each other; the smallest text stands for it, and rows with
another text stay as they are. A row without an id is not compared. An empty table gives an empty
result. Further columns of the input are passed on unchanged; one named ``n_removed`` is replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, by_rows, stored

BLOCK_WORDS = 40
BROADCAST_BYTES = 16 << 20


def _anchors(a: list, b: list, a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Lines unique in both ranges, the longest selection that rises on both sides."""
    in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    at_b = {h: j for j, h in enumerate(b[b0:b1], b0) if in_b[h] == 1 and in_a.get(h) == 1}
    both = [(i, at_b[h]) for i, h in enumerate(a[a0:a1], a0) if h in at_b]
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(both):
        pile = bisect_left(tops, j)
        back.append(piles[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            piles.append(k)
        else:
            tops[pile], piles[pile] = j, k
    out = []
    k = piles[-1] if piles else -1
    while k >= 0:
        out.append(both[k])
        k = back[k]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions of two sequences, in order."""
    matched: list[tuple[int, int]] = []
    ranges = [(0, len(a), 0, len(b))]
    while ranges:
        a0, a1, b0, b1 = ranges.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        low = (a0, b0)
        anchors = _anchors(a, b, a0, a1, b0, b1)
        for i, j in anchors:
            matched.append((i, j))
            ranges.append((low[0], i, low[1], j))
            low = (i + 1, j + 1)
        if anchors:
            ranges.append((low[0], a1, low[1], b1))
    return sorted(matched)


def common_blocks(first: list, later: list, sizes: list[int], least: int) -> list[int]:
    """Lines of ``later`` inside aligned runs of at least ``least`` words."""
    out: list[int] = []
    run: list[int] = []
    before = None
    for i, j in [*patience(first, later), (None, None)]:
        if before is None or i is None or (i, j) != (before[0] + 1, before[1] + 1):
            if sum(sizes[k] for k in run) >= least:
                out += run
            run = []
        if i is not None:
            run.append(j)
        before = (i, j)
    return out


def runs(hashes: list[int], sizes: list[int], least: int) -> list[tuple[int, int, int]]:
    """``(start, end, key)`` of the shortest runs of at least ``least`` words from each line with words, and back from it."""
    lines = np.array(hashes, np.int64)
    words = np.concatenate(([0], np.cumsum(sizes)))
    full = np.flatnonzero(np.array(sizes) > 0)
    ends = np.searchsorted(words, words[full] + least)  # the first end with so many words
    starts = np.searchsorted(words, words[full + 1] - least, side="right") - 1  # the last start
    spans = {(int(i), int(e)) for i, e in zip(full, ends, strict=True) if e < len(words)}
    spans |= {(int(i), int(j) + 1) for i, j in zip(starts, full, strict=True) if i >= 0}
    return [(i, e, xxhash.xxh3_64_intdigest(lines[i:e].tobytes()) - (1 << 63)) for i, e in sorted(spans)]


def shared_blocks(first: list, first_sizes: list[int], later: list, sizes: list[int], least: int) -> list[int]:
    """Lines of ``later`` inside aligned blocks of at least ``least`` words."""
    there: dict[int, list[tuple[int, int]]] = {}
    for i, e, key in runs(first, first_sizes, least):
        there.setdefault(key, []).append((i, e))
    left = [r for r in runs(later, sizes, least) if r[2] in there]
    gone: set[int] = set()
    while left:
        in_a = {k for key in {r[2] for r in left} for i, e in there[key] for k in range(i, e)}
        in_b = {k for i, e, _ in left for k in range(i, e)}
        # other lines are told apart from all; blank ones go along with their neighbours
        a = [x if k in in_a or not first_sizes[k] else (0, k) for k, x in enumerate(first)]
        b = [x if k in in_b or not sizes[k] else (1, k) for k, x in enumerate(later)]
        found = set(common_blocks(a, b, sizes, least)) - gone
        gone |= found or in_b  # lines that only cross each other: each run is a block by itself
        left = [r for r in left if not gone.issuperset(range(r[0], r[1]))]
    return sorted(gone)


def _align(least: int):
    def run(batches):
        for part in by_rows(batches):
            ids, removed = [], []
            for _, later, a, a_sizes, b, sizes in zip(*[c.to_pylist() for c in part.columns], strict=True):
                lines = shared_blocks(a, a_sizes, b, sizes, least)
                if lines:
                    ids.append(later)
                    removed.append(lines)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(removed, pa.list_(pa.int32()))], names=["later", "lines"])

    return run


def _keys(least: int):
    def run(batches):
        for part in by_rows(batches):
            keys = [sorted({k for _, _, k in runs(h, n, least)}) for h, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "keys"])

    return run


def _flags(batches):
    """One flag per line up to the last deleted one."""
    for part in by_rows(batches):
        flags = []
        for lists in part.column(1).to_pylist():
            gone = set().union(*lists)
            flags.append([i in gone for i in range(max(gone) + 1)])
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(flags, pa.list_(pa.bool_()))], names=["later", "drop"])


def document_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, mark, hashes, sizes)``: of each document the hash of its text and, by line, hashes and numbers of words."""
    lines = F.split("text", "\n")
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("mark"), "text")
    arrays = rows.select(
        "doc_id", "mark",
        F.transform(lines, lambda x: F.xxhash64(F.btrim(x, F.lit(SPACES)))).alias("hashes"),
        F.transform(lines, lambda x: F.regexp_count(x, F.lit(WORD))).alias("sizes"),
    )
    found = stored(arrays, "lines")
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        return found
    smallest = rows.groupBy("doc_id").agg(F.min("text").alias("text"))
    marks = smallest.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("of"))
    one = found.join(marks, (found["doc_id"] == marks["id"]) & (found["mark"] == marks["of"])).drop("id", "of")
    return stored(one.dropDuplicates(["doc_id"]), "lines")


def overlaps(lines: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Distinct pairs ``(first, later)``: a document and the first one that holds a run of its lines."""
    keyed = lines.select("doc_id", "hashes", "sizes").mapInArrow(_keys(block_words), "doc_id bigint, keys array<bigint>")
    each = stored(keyed, "run-keys").select("doc_id", F.explode("keys").alias("key"))
    firsts = each.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("df")).where("df > 1").select(F.col("key").alias("__key"), "first")
    held = each.join(firsts, F.col("key") == F.col("__key")).where("first < doc_id")
    return held.select("first", F.col("doc_id").alias("later")).distinct()


def aligned_lines(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, mark, drop)``: for each document that loses lines, its text's hash and a flag for each line."""
    lines = document_lines(docs)
    pairs = stored(overlaps(lines, block_words), "overlaps")
    a = lines.select(F.col("doc_id").alias("first"), F.col("hashes").alias("a"), F.col("sizes").alias("a_sizes"))
    b = lines.select(F.col("doc_id").alias("later"), F.col("hashes").alias("b"), "sizes")
    both = pairs.join(a, "first").join(b, "later").select("first", "later", "a", "a_sizes", "b", "sizes")
    found = both.mapInArrow(_align(block_words), "later bigint, lines array<int>")
    merged = found.groupBy("later").agg(F.collect_set("lines").alias("lists"))
    flags = merged.mapInArrow(_flags, "later bigint, drop array<boolean>")
    return lines.select("doc_id", "mark").join(flags, F.col("doc_id") == F.col("later")).select("doc_id", "mark", "drop")


def drop_aligned(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` (``doc_id``, ``text`` and any others) with the deleted lines out of ``text`` and their number as ``n_removed``."""
    drops = stored(aligned_lines(docs.select("doc_id", "text"), block_words), "drops")
    if (drops.agg(F.sum(24 + F.size("drop"))).first()[0] or 0) <= BROADCAST_BYTES:
        drops = F.broadcast(drops)
    # the table's columns travel as one, so that none of them can clash with those that are added
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = (F.col("row.doc_id") == F.col("doc_id")) & (F.xxhash64("row.text") == F.col("mark"))
    joined = rows.join(drops, same, "left")
    left = F.filter(F.split("row.text", "\n"), lambda x, i: ~F.coalesce(F.get("drop", i), F.lit(False)))
    text = F.when(F.col("drop").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    removed = F.when(F.col("drop").isNull(), F.lit(0)).otherwise(F.size(F.filter("drop", lambda x: x)))
    others = [text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c != "n_removed"]
    return joined.select(*others, removed.alias("n_removed"))
