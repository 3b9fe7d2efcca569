import random

import numpy as np
import pytest

from topicloom.llm import graph, minmax
from topicloom.llm.common import texts


def shingles(text, width):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    k = min(width, len(w))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def brute(rows, width):
    sets = {d: shingles(t, width) for d, t in rows if d is not None}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                lo, hi = sorted((find(a), find(b)))
                up[hi] = lo
    return {d: (len(sets[d]), find(d)) for d in ids}


def variants(n, seed, rate):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(80)]
    out = [list(base)]
    for _ in range(n - 1):
        out.append([w if rng.random() > rate else f"v{rng.randint(0, 999)}" for w in rng.choice(out)])
    return [" ".join(v) for v in out]


@pytest.mark.parametrize("width", [2, 5])
def test_chains_of_edits_against_all_pairs(spark, width):
    """Edited copies of edited copies: similarities all around the threshold, in one large group."""
    rows = list(enumerate(variants(90, 1, 0.03) + variants(40, 2, 0.06) + ["a", "A", "b", "", "a b", "A  b", None, "c d e f g"]))
    got = minmax.near_duplicates(texts(spark.createDataFrame(rows, "doc_id long, text string")), width=width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_awkward_rows(awkward):
    rows = awkward.select("doc_id", "text").collect()
    got = minmax.near_duplicates(texts(awkward), width=2).collect()
    assert len(got) == len(rows)
    want = brute(rows, 2)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]


def test_one_id_with_two_texts(spark):
    rows = [(1, "a b c d e f"), (2, "q r s t u v"), (2, "a b c d e f"), (3, "q r s t u v")]
    got = minmax.near_duplicates(texts(spark.createDataFrame(rows, "doc_id long, text string")), width=2).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (2, 1), (3, 3)]


def test_empty_table(empty):
    assert minmax.near_duplicates(texts(empty)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 150)], "a long, b long")
    got = {r.node: r.label for r in graph.components(links).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 150: 100, 200: 100}


@pytest.mark.parametrize("rate,width", [(0.08, 1), (0.05, 1), (0.03, 2)])
def test_prefixes_lose_no_similar_pair(spark, rate, width):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(w if rng.random() > rate else f"v{rng.randint(0, 300)}" for w in base[: rng.randint(90, 120)])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingles(t, width) for i, t in rows}
    open_ = spark.createDataFrame([(i, len(s), i) for i, s in sets.items()], "node long, n long, label long")
    found = {(r.a, r.b) for r in minmax.prefix_pairs(docs, open_, width, 80).collect()}
    similar = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert similar <= found and len(similar) > 20


def test_many_texts_that_share_bands_but_do_not_link(spark):
    """3,000 copies, each with own words for a ninth of it: similar to each other below the threshold."""
    n = 3000
    rng = random.Random(9)
    rows = []
    for i in range(n):
        own = set(rng.sample(range(180), 28))
        rows.append((i, " ".join(f"own{i}x{k}" if k in own else f"w{k}" for k in range(180))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    open_ = spark.createDataFrame([(i, 180, i) for i in range(n)], "node long, n long, label long")
    assert minmax.prefix_pairs(docs, open_, 1, 80).count() == 0  # of 4,498,500
    got = minmax.near_duplicates(docs, width=1)
    assert got.where("kept").count() == n


def test_all_pairs_of_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    sets = {d: shingles(t, 2) for d, t in rows}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets, key=lambda d: len(sets[d]))
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            s, t = sets[a], sets[b]
            if 100 * len(s) < 80 * len(t):
                break
            if s and 100 * len(s & t) >= 80 * len(s | t):
                lo, hi = sorted((find(a), find(b)))
                up[hi] = lo
    got = minmax.near_duplicates(texts(docs), width=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {d: (len(sets[d]), find(d)) for d in sets}


def test_bitmaps_differ_at_most_as_the_sets():
    rng = random.Random(5)
    for size in (0, 1, 30, 400, 5000):
        a = {rng.getrandbits(64) for _ in range(size)}
        b = {x for x in a if rng.random() < 0.9} | {rng.getrandbits(64) for _ in range(size // 10)}
        bits = [minmax.parity(np.array(sorted(x), np.uint64)).view(np.uint64) for x in (a, b)]
        assert sum(int(x).bit_count() for x in bits[0] ^ bits[1]) <= len(a ^ b)
