"""Sparse linear models over hashed word features: training sample, features, dot products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHash, by_rows, split_bytes

SEED = 0x51ED270B


def training_sample(docs: DataFrame, labels: DataFrame, target: str, train: Column, rows: int) -> list[tuple[str, int]]:
    """At most ``rows`` labelled texts, those with the smallest hashes of their id, in that order.

    This is the documented bound of what is fitted in one place. Labels that are null or belong to no
    document are left out; of several labels for one id the larger counts.
    """
    named = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & train)
    named = named.groupBy("doc_id").agg(F.max(F.col(target).cast("int")).alias("label"))
    chosen = named.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(rows)
    ids = chosen.select(F.col("doc_id").alias("id"), "label")
    got = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("doc_id", "label", "text").toArrow().to_pylist()
    order = WordHash(limit=1)
    got.sort(key=lambda r: (order[str(r["doc_id"]).encode()], r["doc_id"], r["text"]))
    return [(r["text"], r["label"]) for r in got]


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of a sequence of word hashes."""
    out = np.full(max(len(hashes) - n + 1, 0), n, np.uint64)
    for i in range(n):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[i:i + len(out)]
    return out ^ (out >> np.uint64(32))


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Distinct weight positions of hashed features."""
    return np.unique((hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def score_texts(docs: DataFrame, featurize, weights: np.ndarray, bias: float) -> DataFrame:
    """``(doc_id, score)``: each text's sparse dot product, through the logistic function.

    ``featurize`` gives positions and values. The weights have a fixed length, a parameter of the
    model, so sending them to every task is bounded.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        for part in by_rows(batches):
            out = []
            for text in part.column(1).to_pylist():
                at, value = featurize(text)
                out.append(float(sigmoid(bias + (w[at] * value).sum())))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id bigint, score double")


__all__ = ["combine", "score_texts", "sigmoid", "slots", "split_bytes", "training_sample"]
