"""Toxicity scores from a factorization machine over hashed terms.

Terms are a text's lower-cased words, stripped of outer punctuation, and the words' first
letters (words of one stem share them), hashed into a fixed number of buckets. Besides a weight per term the
model holds a short vector per term; the inner product of two terms' vectors is the weight of
their meeting in one text, so that an insult together with the mention of a group counts for
more than both alone, which no additive weights can say. So every term in enough sampled texts is
fitted: a term that says nothing alone may still say something together with another.

The fit uses at most ``sample_rows`` labelled rows (those of the smallest hash of the id).
Scores depend on the text alone.

Defined cases: null and empty texts have no terms and get the score of the bias; a text of any length is scored whole; rows with null or repeated ids are each scored;
with no labelled rows every score is next to 0; an empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from . import hashed_text as H

FACTORS = 8
EPOCHS = 12
BATCH = 256  # rows of a step at most; small samples take smaller steps, so that there are enough of them
STEPS = 64
RATE = 0.1
DECAY = 1e-4
PREFIXES = (4, 5)
_EDGES = ".,;:!?\"'()[]{}<>«»„“”‘’…-–—*_|/\\"


def featurizer():
    def buckets(word: str) -> tuple[int, ...]:
        word = word.strip(_EDGES)
        if not word:
            return ()
        return (H.bucket(f"w {word}"), *(H.bucket(f"p {word[:n]}") for n in PREFIXES if len(word) >= n))

    cache = H.Cache(buckets)

    def features(text: str) -> np.ndarray:
        found = set()
        found.update(*map(cache.__getitem__, set(text.lower().split())))
        cache.trim()
        return np.fromiter(found, np.int64, len(found))

    return features


class Machine:
    """bias + sum of weights + sum over pairs of inner products, then the logistic function."""

    def __init__(self, terms: int, factors: int = FACTORS, seed: int = 7):
        self.bias = 0.0
        self.w = np.zeros(terms)
        self.v = np.random.default_rng(seed).normal(0, 0.01, (terms, factors))

    def raw(self, row: np.ndarray, term: np.ndarray, rows: int):
        v = self.v[term]
        total = np.stack([np.bincount(row, v[:, f], rows) for f in range(v.shape[1])], axis=1)
        squares = np.bincount(row, (v * v).sum(axis=1), rows)
        out = self.bias + np.bincount(row, self.w[term], rows) + 0.5 * ((total ** 2).sum(axis=1) - squares)
        return out, total, v

    def score(self, row, term, rows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(row, term, rows)[0], -40, 40)))

    def fit(self, y, offsets, terms, epochs=EPOCHS, rate=RATE, decay=DECAY, seed=11):
        """Stochastic gradient descent with per-coordinate steps (Adagrad) on the logistic loss."""
        rng = np.random.default_rng(seed)
        batch = int(np.clip(len(y) // STEPS, 8, BATCH))
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        g_b, g_w, g_v = 1e-8, np.full(self.w.shape, 1e-8), np.full(self.v.shape, 1e-8)
        n, factors = len(self.w), self.v.shape[1]
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for k in range(0, len(y), batch):
                rows = order[k: k + batch]
                row, term = H.batches_of(offsets, terms, rows)
                raw, total, v = self.raw(row, term, len(rows))
                err = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y[rows]) / len(rows)
                used, at = np.unique(term, return_inverse=True)
                d_w = np.bincount(at, err[row], len(used)) + decay * self.w[used]
                pull = err[row][:, None] * (total[row] - v)
                d_v = np.stack([np.bincount(at, pull[:, f], len(used)) for f in range(factors)], axis=1).astype(float)
                d_v += decay * self.v[used]
                g_b += err.sum() ** 2
                self.bias -= rate * err.sum() / np.sqrt(g_b)
                g_w[used] += d_w ** 2
                self.w[used] -= rate * d_w / np.sqrt(g_w[used])
                g_v[used] += d_v ** 2
                self.v[used] -= rate / 4 * d_v / np.sqrt(g_v[used])
        return self


def fit(docs: DataFrame, labels: DataFrame, label: Column, id_col: str = "doc_id", text_col: str = "text",
        sample_rows: int = H.SAMPLE_ROWS, epochs: int = EPOCHS):
    """(terms, machine) fitted on the documents that ``labels`` names; label is 0 or 1."""
    rows = H.training_rows(docs, id_col, text_col, H.sample(labels, id_col, label, sample_rows), featurizer)
    terms = H.frequent(rows)
    y, offsets, found = H.collected(rows, terms)
    machine = Machine(len(terms))
    if len(y):
        machine.fit(y, offsets, found, epochs)
    else:
        machine.bias = -np.inf
    machine.w, machine.v = machine.w.astype(np.float32), machine.v.astype(np.float32)  # as sent to the tasks
    return terms, machine


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text",
          keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: the id) and ``score`` of every row."""
    terms, machine = model
    return H.scored(docs, id_col, text_col, featurizer, terms,
                    lambda row, term, n: [machine.score(row, term, n)], [("score", "double")], keep)
