import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from topicloom.llm import ctw
from topicloom.llm.common import texts


def brute(train, text, depth):
    """Weighted context trees built one decision at a time, in logarithms."""
    stream = lambda t: b"\n" * depth + b"".join(w + b" " for w in t.encode().lower().split()) + b"\n"
    counts = {}
    for t in train:
        data = stream(t)
        for i in range(depth, len(data)):
            for k in range(8):
                node, bit = 1 << k | data[i] >> (8 - k), data[i] >> (7 - k) & 1
                for d in range(depth + 1):
                    counts.setdefault((data[i - d:i], node), [0, 0])[bit] += 1
    children = {}
    for ctx, node in counts:
        if ctx:
            children.setdefault((ctx[1:], node), []).append((ctx, node))
    kt = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(n[0] + n[1] + 1) - math.log(math.pi)
    memo = {}

    def weighted(key):
        if key not in memo:
            if len(key[0]) == depth:
                memo[key] = kt(counts[key])
            else:
                memo[key] = np.logaddexp(math.log(0.5) + kt(counts[key]), math.log(0.5) + sum(map(weighted, children.get(key, []))))
        return memo[key]

    total, data = 0.0, stream(text)
    for i in range(depth, len(data)):
        for k in range(8):
            node, bit = 1 << k | data[i] >> (8 - k), data[i] >> (7 - k) & 1
            p = None
            for d in range(depth, -1, -1):
                key = (data[i - d:i], node)
                n = counts.get(key, [0, 0])
                own = (n[bit] + 0.5) / (sum(n) + 1)
                stop = 1.0 if d == depth else math.exp(math.log(0.5) + kt(n) - weighted(key)) if key in counts else 0.5
                p = own if p is None else stop * own + (1 - stop) * p
            total += math.log10(p)
    return total


TEXTS = ["the cat sat on the mat", "The dog sat", "a cat, a dog", "", "ünder the mat", "the cat sat on the mat", "dog dog dog", "zebra  mat\nx"]


@pytest.mark.parametrize("lots", [{}, {"lot_bytes": 20, "lots_together": 2, "part_rows": 30}])
def test_scores_against_trees_built_one_by_one(spark, lots):
    docs = spark.createDataFrame([*enumerate(TEXTS), (9, None), (None, "mat"), (0, TEXTS[0])], "doc_id long, text string")
    held = F.col("doc_id").isin(5, 6, 7)
    got = ctw.score(texts(docs), ~F.coalesce(held, F.lit(False)), **lots).collect()
    train = [t for i, t in enumerate(TEXTS) if i not in (5, 6, 7)] + ["", "mat", TEXTS[0]]
    counts = {}
    for t in train:
        for w in [*t.lower().split(), "\n"]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    assert len(got) == 11
    by_id = {r.doc_id: r for r in got}
    for i, t in [*enumerate(TEXTS), (9, ""), (None, "mat")]:
        tokens = [*t.lower().split(), "\n"]
        r = by_id[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(w in counts for w in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in tokens))
        assert r.score == pytest.approx(brute(train, t, ctw.DEPTH), abs=1e-4)
        assert r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / (sum(len(w.encode()) for w in tokens) + len(tokens) - 1))


def test_counts_keep_their_values_in_narrow_rows():
    counts = np.array([0, 1, 255, 256, 65535, 65536, 3, 1 << 24, 0, 1 << 40, 5, 0], np.int64)
    cut = np.array([0, 3, 4, 6, 8, 11])
    n = np.diff(np.append(cut, len(counts)))
    column = ctw._narrow(counts, cut, n)
    assert [len(b) // k for b, k in zip(column.to_pylist(), n.tolist(), strict=True)] == [1, 2, 3, 4, 6, 1]
    assert (ctw._counts(n, column) == counts).all()


def test_probabilities_of_a_byte_add_to_one():
    rng = np.random.default_rng(1)
    keys = np.uint64(0x666564636261) << np.uint64(8) | np.arange(256, dtype=np.uint64)
    counts = rng.integers(0, 9, 256) * (rng.random(256) < 0.3)
    columns = [[name, n, low, data] for name, low, data, n in ctw._rows(ctw.SEQUENCE, keys, counts)]
    sums = list(ctw._upper_sums([pa.RecordBatch.from_arrays(c, names=["name", "n", "keys", "data"]) for c in columns]))
    node, *totals = (np.concatenate([b.column(i).to_numpy() for b in sums]) for i in range(4))
    top = ctw._top(node.view(np.uint64), *totals)
    assert (10 ** ctw.log_probabilities(ctw.Forest(keys, counts), top)).sum() == pytest.approx(1.0)


def test_equal_texts_get_equal_scores_in_any_split(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = F.col("doc_id") % 5 != 1
    runs = [ctw.score(docs.repartition(p), train, lot_bytes=b, lots_together=t).collect() for p, b, t in ((1, 1 << 30, 9), (7, 300, 3))]
    first, second = ({r.doc_id: r for r in run} for run in runs)
    assert len(first) == 400 and first == second
    for i in range(len(TEXTS)):
        assert len({first[k].score for k in range(i, 400, len(TEXTS))}) == 1


def test_no_training_texts_and_empty_table(spark, empty):
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    (r,) = ctw.score(docs, F.lit(False)).collect()
    assert r.score == pytest.approx(4 * 8 * math.log10(0.5)) and r.n_known == 0 and r.train_tokens == 0
    assert ctw.score(texts(empty), F.lit(True)).count() == 0


def test_arrow_splits_texts_as_bytes_are_split():
    odd = ["", " ", "\t a  B\n", "x", "É Aİ b\x0bc\x0c\r", "日本 語 ", "a\x85b\u00a0c \u2003 d", "Q" * 50, "a b"]
    part = pa.array(["left out", *odd]).slice(1)
    words, numbers = ctw.split_words(part)
    want = [t.encode().lower().split() for t in odd]
    assert words.to_pylist() == [w for ws in want for w in ws] and numbers.tolist() == [len(ws) for ws in want]
    keys, sizes = ctw.streams(words, numbers)
    padded = [b"\n" * ctw.DEPTH + b" ".join([*ws, b"\n"]) for ws in want]
    assert sizes.tolist() == [len(p) - ctw.DEPTH for p in padded]
    assert keys.tolist() == [int.from_bytes(p[i - ctw.DEPTH:i][::-1] + p[i:i + 1], "big") for p in padded for i in range(ctw.DEPTH, len(p))]
    distinct, at = ctw.places(keys)
    assert (distinct[at] == keys).all() and (np.diff(distinct.astype(np.int64)) > 0).all()
