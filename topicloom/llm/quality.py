"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A text is the set of its words and word pairs, case kept, hashed to ``2^BITS`` weights; each feature
present has the value ``1 / sqrt(number of features)``. Training goes once or more over a bounded
sample of labelled texts and updates each feature with its own rate; the L1 term keeps weights of
features that did not prove useful at exactly 0 (FTRL-Proximal). Scores are sparse dot products.

A null, empty or blank text has no features: its score is that of the bias. Scores depend on the
text alone. Without labelled rows every score is 0.5. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from .common import WordHash
from .linear import combine, score_texts, sigmoid, slots, split_bytes, training_sample

BITS = 20
SAMPLE_ROWS = 12_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 3.0, 1.0, 0.01, 0.001
_WORDS = WordHash()


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    words = split_bytes(text)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    at = slots(np.concatenate([combine(h, 1), combine(h, 2)]), BITS)
    return at, np.full(len(at), 1 / np.sqrt(max(len(at), 1)))


class Leader:
    """FTRL-Proximal state; the last slot is the bias, without L1."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, L1)
        w = (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def update(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        at, value = np.append(at, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(at)
        g = (sigmoid((w * value).sum()) - label) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(sample: list[tuple[str, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias."""
    state = Leader(1 << BITS)
    made = [(*features(text), label) for text, label in sample]
    for _ in range(epochs):
        for at, value, label in made:
            state.update(at, value, label)
    w = state.weights(np.arange(len(state.z)))
    return w[:-1].astype(np.float32), float(w[-1])


def classify(docs: DataFrame, labels: DataFrame, train: Column, target: str = "quality", rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, score)`` for all ``docs`` (``doc_id``, non-null ``text``), fitted to the labels where ``train``."""
    weights, bias = fit(training_sample(docs, labels, target, train, rows))
    return score_texts(docs, features, weights, bias)
