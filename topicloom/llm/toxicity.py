"""Toxicity classifier whose scores do not move when identity terms are swapped.

A text is the set of its words, folded to lower case and freed of punctuation at the ends, and of
the words' first letters. The loss of a labelled text is its logistic loss; for every text with an
identity term, a counterfactual is made by swapping each term for another one of its list, and
``PENALTY`` times the squared difference of the two log-odds is added. The penalty pulls the weights
of terms that only name a group together, so that the context has to carry the label.

Fitted by adaptive gradient steps (one rate per feature) with an L1 term on a bounded sample of
labelled texts. A null, empty or blank text has no features: its score is that of the bias. Scores
depend on the text alone. Without labelled rows every score is 0.5. An empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame

from .common import WordHash
from .linear import score_texts, sigmoid, slots, split_bytes, training_sample

BITS = 20
SAMPLE_ROWS = 16_000
EPOCHS = 6
RATE, L1 = 0.4, 2e-4
PENALTY = 1.0
PREFIX = 5
EDGE = b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum())

# Groups that neutral text mentions; each term may stand for any other of its row.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "mothers", "fathers"),
    ("woman", "man", "girl", "boy", "mother", "father"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists", "sikhs"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens", "migrants"),
    ("deaf", "blind", "disabled", "paralyzed", "autistic"),
    ("old", "young", "elderly", "teenage"),
    ("frauen", "männer", "mädchen", "jungen", "muslime", "christen", "juden", "ausländer", "deutsche"),
    ("femmes", "hommes", "filles", "garçons", "musulmans", "chrétiens", "juifs", "étrangers", "français"),
    ("mujeres", "hombres", "chicas", "chicos", "musulmanes", "cristianos", "judíos", "extranjeros", "españoles"),
)
_TERMS = {t.encode(): [o.encode() for o in row if o != t] for row in IDENTITY_TERMS for t in row}


class _Forms(WordHash):
    """Hashes of a word and of its beginning, by the raw word."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= self.limit:
            self.clear()
        plain = word.strip(EDGE) or word
        start = plain.decode("utf-8", "replace")[:PREFIX].encode()
        value = self[word] = (xxhash.xxh3_64_intdigest(plain, 1), xxhash.xxh3_64_intdigest(start, 2))
        return value


_FORMS = _Forms()


def _features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = list(map(_FORMS.__getitem__, set(words)))
    at = slots(np.array(pairs, np.uint64).reshape(-1), BITS)
    return at, np.ones(len(at), np.float32)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    return _features(split_bytes(text, lower=True))


def counterfactual(text: str, seed: int) -> list[bytes] | None:
    """The words with every identity term swapped; None where there is no such term."""
    words = split_bytes(text, lower=True)
    plain = [w.strip(EDGE) for w in words]
    if not any(p in _TERMS for p in plain):
        return None
    out = []
    for w, p in zip(words, plain, strict=True):
        others = _TERMS.get(p)
        out.append(w.replace(p, others[xxhash.xxh3_64_intdigest(p, seed) % len(others)]) if others else w)
    return out


def fit(sample: list[tuple[str, int]], epochs: int = EPOCHS, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights and bias."""
    made = []
    for k, (text, label) in enumerate(sample):
        swapped = counterfactual(text, k)
        made.append((features(text)[0], label, _features(swapped)[0] if swapped else None))
    w, square = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8)
    bias, bias_square = 0.0, 1e-8
    if not made:
        return w.astype(np.float32), bias

    def step(at, g):
        square[at] += g * g
        rate = RATE / np.sqrt(square[at])
        moved = w[at] - rate * g
        w[at] = np.sign(moved) * np.maximum(np.abs(moved) - rate * L1, 0)

    for _ in range(epochs):
        for at, label, other in made:
            odds = bias + w[at].sum()
            g = float(sigmoid(odds) - label)
            # long texts have many features: the step is shared among them
            step(at, np.full(len(at), g / np.sqrt(max(len(at), 1))))
            bias_square += g * g
            bias -= RATE * 0.1 * g / np.sqrt(bias_square)
            if other is not None:
                mine, theirs = np.setdiff1d(at, other), np.setdiff1d(other, at)
                gap = float(w[mine].sum() - w[theirs].sum())
                step(mine, np.full(len(mine), 2 * penalty * gap))
                step(theirs, np.full(len(theirs), -2 * penalty * gap))
    return w.astype(np.float32), float(bias)


def classify(docs: DataFrame, labels: DataFrame, train: Column, target: str = "toxic", rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, score)`` for all ``docs`` (``doc_id``, non-null ``text``), fitted to the labels where ``train``."""
    weights, bias = fit(training_sample(docs, labels, target, train, rows))
    return score_texts(docs, features, weights, bias)
