"""The manifest against a plain tree in memory."""
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from topicloom.llm import merkle
from topicloom.llm.queries import QUERIES


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    values = [row[f] for f in merkle.FIELDS]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def fold(nodes, at, fanout, node):
    """Root and siblings on the way of a node; ``node`` stands in the place of ``at``."""
    way = []
    while len(nodes) > 1:
        first = at - at % fanout
        before, after = nodes[first:at], nodes[at + 1:first + fanout]
        way += before + after
        node = h(*before, node, *after)
        nodes = [h(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
        at //= fanout
    return node, way


def plain(rows, fanout=8):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    trees = {k: sorted(trees[k], key=lambda t: t[:3]) for k in sorted(trees, key=lambda x: (x is not None, (x or "").encode()))}
    subroots = []
    for t in trees.values():
        nodes = [x[2] for x in t]
        subroots.append(fold(nodes, 0, fanout, nodes[0])[0])
    root = fold(subroots, 0, fanout, subroots[0])[0] if subroots else None
    out = []
    for k, t in enumerate(trees.values()):
        nodes = [x[2] for x in t]
        for i, (_, _, own, r) in enumerate(t):
            other = own
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                other = leaf({**r, "text": r["text"].translate(low)})
            sub, way = fold(nodes, i, fanout, other)
            again, above = fold(subroots, k, fanout, sub)
            out.append((r["doc_id"], own, subroots[k], root, h(*way, *above), again, again == root))
    return sorted(out, key=str)


def rows_of(docs):
    return [r.asDict() for r in docs.select(*merkle.FIELDS).collect()]


@pytest.mark.parametrize("levels,fanout", [(4, 8), (1, 2), (1, 3), (2, 2)])
def test_manifest_of_awkward_rows(awkward, levels, fanout):
    got = sorted((tuple(r) for r in merkle.manifest(awkward, levels, fanout).collect()), key=str)
    assert got == plain(rows_of(awkward), fanout)


def test_many_languages_of_unequal_size(spark):
    sizes = [1, 70, 2, 3, 0, 9, 17, 1, 8, 64, 65, 5, 1, 1, 33, 2, 1, 130, 4]
    rows = [(1000 * k + i, f"Text {i}", f"l{k:02d}" if k else None, "s", i) for k, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    for levels, fanout in ((1, 2), (1, 3), (1, 8), (0, 4)):
        assert sorted((tuple(r) for r in merkle.manifest(docs, levels, fanout).collect()), key=str) == plain(rows_of(docs), fanout)


def test_one_row_and_none(spark, empty):
    one = spark.sql("SELECT 7L AS doc_id, 'A' AS text, 'en' AS lang, 's' AS source, 1L AS n_chars")
    r = merkle.manifest(one).first()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == h("")
    assert merkle.manifest(empty).count() == 0


def test_query_on_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["op11_butterfly_manifest"](spark, "/root/testdata/sf0.01").collect()), key=str)
    assert got == plain(rows_of(docs))
    assert docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0).count() >= sum(not x[-1] for x in got) > 0
