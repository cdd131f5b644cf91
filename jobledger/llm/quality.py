"""Quality grades by ordinal cumulative-link regression over hashed text features.

With grades 0 .. G-1 the model is ``P(grade <= j) = logistic(threshold_j - w . x)``: one set of
weights shared by all grades, and ordered thresholds. It gives the expected grade and, for
selection, the tail probability ``P(grade >= keep_grade)``.

Features of a whole text, all hashed into buckets: its words; the shapes of its words (runs of
letters, digits and signs) with the share of words that have them, in steps of powers of two; the
share of distinct words, of distinct lines and of words that repeat the one before; lengths.

The fit uses at most ``sample_rows`` rated rows (those of the smallest hash of the id).

Defined cases: a text of any length is scored whole; null and empty texts are graded by their one feature of length nought, so they
have a grade like any other; rows with null or repeated ids are each graded; without rated rows nothing is known, and every
tail probability is 1 and every expected grade the highest, so nothing is rejected; an empty table gives an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashed_text as H

EPOCHS = 12
BATCH = 256  # rows of a step at most; small samples take smaller steps, so that there are enough of them
STEPS = 64
RATE = 0.1
DECAY = 1e-4
_RUNS = [(re.compile(r"[a-zß-öø-ÿ]+"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[0-9]+"), "0"),
         (re.compile(r"([^aA0])\1+"), r"\1")]


def shape(word: str) -> str:
    for pattern, sign in _RUNS:
        word = pattern.sub(sign, word)
    return word


def _step(share: float) -> int:
    return math.ceil(-math.log2(max(share, 1e-6)))


def featurizer():
    words_of = H.Cache(lambda w: (H.bucket(f"w {w}"), H.bucket(shape(w))))
    derived = H.Cache(lambda key: H.bucket(" ".join(map(str, key))))

    def features(text: str) -> np.ndarray:
        words = text.split()
        n = len(words)
        out = {derived["n", n.bit_length()]}
        if n:
            counts = Counter(words)
            lines = [x for x in text.split("\n") if x.strip()]
            again = sum(map(str.__eq__, words, words[1:]))
            shapes: Counter = Counter()
            for word, times in counts.items():
                w, s = words_of[word]
                out.add(w)
                shapes[s] += times
            for s, times in shapes.items():
                out.add(derived["shape", s, _step(times / n)])
            out.add(derived["distinct", int(20 * len(counts) / n), n.bit_length()])
            out.add(derived["distinct", int(5 * len(counts) / n)])
            out.add(derived["again", _step(again / n)])
            out.add(derived["repeats", again * 20 > n])
            out.add(derived["lines", int(10 * len(set(lines)) / len(lines))])
            out.add(derived["mean", int(len(text) / n)])
        words_of.trim()
        derived.trim()
        return np.fromiter(out, np.int64, len(out))

    return features


class Ordinal:
    """Shared weights and ordered thresholds (the first, then logarithms of the gaps)."""

    def __init__(self, terms: int, grades: int):
        self.grades = grades
        self.w = np.zeros(terms)
        self.first = 0.0
        self.gaps = np.zeros(grades - 2)

    def thresholds(self) -> np.ndarray:
        return self.first + np.concatenate([[0.0], np.cumsum(np.exp(self.gaps))])

    def at_most(self, row, term, rows) -> np.ndarray:
        """P(grade <= j), j = 0 .. grades - 2, per row."""
        x = np.bincount(row, self.w[term], rows)
        return 1 / (1 + np.exp(-np.clip(self.thresholds()[None, :] - x[:, None], -40, 40)))

    def grade(self, row, term, rows, keep_grade: int) -> list[np.ndarray]:
        """[expected grade, P(grade >= keep_grade)]."""
        below = self.at_most(row, term, rows)
        return [(1 - below).sum(axis=1), 1 - below[:, keep_grade - 1]]

    def fit(self, y, offsets, terms, epochs=EPOCHS, rate=RATE, decay=DECAY, seed=5):
        """Stochastic gradient descent with per-coordinate steps (Adagrad) on the negative log-likelihood."""
        share = np.clip([(y <= j).mean() for j in range(self.grades - 1)], 1e-3, 1 - 1e-3)
        start = np.log(share / (1 - share))
        self.first = float(start[0])
        self.gaps = np.log(np.maximum(np.diff(start), 1e-2))
        rng = np.random.default_rng(seed)
        batch = int(np.clip(len(y) // STEPS, 8, BATCH))
        g_w, g_t = np.full(self.w.shape, 1e-8), np.full(self.grades - 1, 1e-8)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for k in range(0, len(y), batch):
                rows = order[k: k + batch]
                row, term = H.batches_of(offsets, terms, rows)
                below = self.at_most(row, term, len(rows))
                full = np.concatenate([np.zeros((len(rows), 1)), below, np.ones((len(rows), 1))], axis=1)
                grade = y[rows]
                hit = np.arange(len(rows))
                up, low = full[hit, grade + 1], full[hit, grade]
                p = np.maximum(up - low, 1e-9)
                # d log p / d(threshold_j - w.x) for the upper and the lower threshold of the grade
                d_up, d_low = up * (1 - up) / p, low * (1 - low) / p
                d_x = (d_up - d_low) / len(rows)
                used, at = np.unique(term, return_inverse=True)
                d_w = np.bincount(at, d_x[row], len(used)) + decay * self.w[used]
                d_theta = np.zeros(self.grades + 1)
                np.add.at(d_theta, grade + 1, -d_up / len(rows))
                np.add.at(d_theta, grade, d_low / len(rows))
                d_theta = d_theta[1:-1]
                d_t = np.concatenate([[d_theta.sum()],
                                      [d_theta[j + 1:].sum() * math.exp(g) for j, g in enumerate(self.gaps)]])
                g_w[used] += d_w ** 2
                self.w[used] -= rate * d_w / np.sqrt(g_w[used])
                g_t += d_t ** 2
                move = rate * d_t / np.sqrt(g_t)
                self.first -= move[0]
                self.gaps -= move[1:]
        return self


def fit(docs: DataFrame, labels: DataFrame, label: Column, grades: int, id_col: str = "doc_id",
        text_col: str = "text", sample_rows: int = H.SAMPLE_ROWS):
    """(terms, model) fitted on the documents that ``labels`` rates from 0 to ``grades`` - 1."""
    rows = H.training_rows(docs, id_col, text_col, H.sample(labels, id_col, label, sample_rows), featurizer)
    terms = H.choose(rows, grades)
    y, offsets, found = H.collected(rows, terms)
    model = Ordinal(len(terms), grades)
    if len(y):
        model.fit(y, offsets, found)
    else:
        model.first = -np.inf
    return terms, model


def score(docs: DataFrame, model, keep_grade: int, id_col: str = "doc_id", text_col: str = "text",
          keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: the id), ``expected_grade`` and ``p_keep`` of every row."""
    terms, ordinal = model
    return H.scored(docs, id_col, text_col, featurizer, terms,
                    lambda row, term, n: ordinal.grade(row, term, n, keep_grade),
                    [("expected_grade", "double"), ("p_keep", "double")], keep)


def select(docs: DataFrame, model, keep_grade: int, threshold: float, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose tail probability is at least ``threshold``, columns as they were."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # clashing names do no harm
    at = {c: f"c{names.index(c)}" for c in (id_col, text_col)}
    rated = score(plain, model, keep_grade, at[id_col], at[text_col], plain.columns)
    return rated.filter(F.col("p_keep") >= threshold).select(*plain.columns).toDF(*names)
