"""Hashed text features and a bounded, labelled training sample, for the classifiers here.

A featurizer turns whole texts into arrays of bucket numbers. Buckets are chosen on the
training sample, for additive models by a chi-squared test against the label, for models of
pairs by their frequency alone; counting is done by Spark, and only
the counts per bucket (a fixed number) and the sample's chosen buckets (a bounded number of
rows) reach the driver, where the small models are fitted.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, written

BUCKETS = 1 << 20
SAMPLE_ROWS = 20_000
MIN_DOCS = 4
MIN_SHARE = 0.001  # of the sampled texts; rarer terms are learnt by heart instead of telling anything
CHI2 = 10.8  # 0.1 % level at one degree of freedom
MAX_TERMS = 50_000


def bucket(name: str) -> int:
    return int.from_bytes(blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") % BUCKETS


class Cache(dict):
    """key -> make(key), each made once per cache life; bounded by ``trim``."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()


Featurizer = Callable[[], Callable[[str], np.ndarray]]


def sample(labels: DataFrame, id_col: str, label: Column, rows: int) -> DataFrame:
    """At most ``rows`` (id, label): those of the smallest hash of the id; null labels take no part."""
    picked = labels.select(F.col(id_col).cast("long").alias("sample_id"), label.cast("int").alias("label"))
    picked = picked.filter("sample_id is not null and label is not null").groupBy("sample_id").agg(F.max("label").alias("label"))
    return picked.orderBy(F.xxhash64("sample_id"), "sample_id").limit(rows)


def training_rows(docs: DataFrame, id_col: str, text_col: str, picked: DataFrame,
                  featurizer: Featurizer) -> DataFrame:
    """label, buckets of the sampled documents. ``picked`` is bounded, so it is broadcast."""
    chosen = docs.select(F.col(id_col).cast("long").alias("sample_id"), F.col(text_col).cast("string").alias("text")) \
                 .join(F.broadcast(picked), "sample_id").select("sample_id", "label", "text")

    def run(batches):
        features = featurizer()
        for batch in batches:
            found = [features(x or "") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))],
                names=["sample_id", "label", "buckets"])

    return written(chosen.mapInArrow(run, "sample_id long, label int, buckets array<int>"), "training")


def choose(rows: DataFrame, grades: int, min_docs: int = MIN_DOCS, chi2: float = CHI2,
           max_terms: int = MAX_TERMS) -> np.ndarray:
    """Buckets whose presence depends on the label, in numeric order."""
    sums = [F.sum((F.col("label") == g).cast("long")).alias(f"g{g}") for g in range(grades)]
    total = rows.agg(*sums).first()
    n_g = np.array([total[g] or 0 for g in range(grades)], float)
    n = n_g.sum()
    counts = rows.select("label", F.explode("buckets").alias("b")).groupBy("b").agg(*sums)
    counts = counts.filter(F.expr(" + ".join(f"g{g}" for g in range(grades))) >= min_docs)
    got = counts.toArrow()  # at most BUCKETS rows
    b = got.column("b").to_numpy()
    if n == 0 or not len(b):
        return np.zeros(0, np.int64)
    c = np.stack([got.column(f"g{g}").to_numpy() for g in range(grades)], axis=1).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        seen = c.sum(axis=1, keepdims=True) * n_g / n
        unseen = (n - c.sum(axis=1, keepdims=True)) * n_g / n
        stat = np.nansum((c - seen) ** 2 / seen + (c - seen) ** 2 / unseen, axis=1)
    order = np.lexsort((b, -stat))
    order = order[stat[order] > chi2][:max_terms]
    return np.sort(b[order]).astype(np.int64)


def frequent(rows: DataFrame, min_docs: int = MIN_DOCS, share: float = MIN_SHARE) -> np.ndarray:
    """Buckets of ``min_docs`` rows and of a ``share`` of all rows or more whatever their labels, in numeric order."""
    min_docs = max(min_docs, int(share * rows.count()))
    counts = rows.select(F.explode("buckets").alias("b")).groupBy("b").count().filter(F.col("count") >= min_docs)
    return np.sort(counts.select("b").toArrow().column("b").to_numpy()).astype(np.int64)  # at most BUCKETS rows


def collected(rows: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels, row offsets, term numbers) of the training rows, chosen buckets only, in order of id."""

    def keep(batches):
        number = _numbers(terms)
        for batch in batches:
            found = [_found(number, np.asarray(x, np.int64)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))],
                                             names=["sample_id", "label", "terms"])

    got = rows.mapInArrow(keep, "sample_id long, label int, terms array<int>").toArrow().sort_by("sample_id")
    lists = got.column("terms").combine_chunks()
    y = got.column("label").to_numpy()
    if not len(y):
        return y, np.zeros(1, np.int64), np.zeros(0, np.int64)
    lens = lists.value_lengths().to_numpy(zero_copy_only=False)
    return y, np.concatenate([[0], np.cumsum(lens)]), lists.flatten().to_numpy().astype(np.int64)


def _numbers(terms: np.ndarray) -> np.ndarray:
    """For every bucket its place among the terms, or -1."""
    number = np.full(BUCKETS, -1, np.int32)
    number[terms] = np.arange(len(terms), dtype=np.int32)
    return number


def _found(number: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Distinct term numbers of the buckets, in numeric order."""
    x = number[buckets]
    return np.unique(x[x >= 0])


def batches_of(offsets: np.ndarray, terms: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number within ``rows``, term) of all terms of the given rows."""
    lens = offsets[rows + 1] - offsets[rows]
    row = np.repeat(np.arange(len(rows)), lens)
    at = np.repeat(offsets[rows] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
    return row, terms[at]


def scored(docs: DataFrame, id_col: str, text_col: str, featurizer: Featurizer, terms: np.ndarray,
           score: Callable[[np.ndarray, np.ndarray, int], list[np.ndarray]], out: list[tuple[str, str]],
           keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: columns ``keep`` (default: the id), then the scores ``out``.

    ``score`` gets (row numbers, term numbers, rows) of some texts and returns a column per output.
    """
    kept = keep or [id_col]
    types = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + [f"{c} {t}" for c, t in out])
    arrow = {"double": pa.float64(), "int": pa.int32()}

    def run(batches):
        features, number = featurizer(), _numbers(terms)
        for batch in batches:
            found = [_found(number, features(x.as_py() or "")) for x in batch.column(0)]
            row = np.repeat(np.arange(len(found)), [len(x) for x in found])
            term = np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)
            cols = score(row, term, len(found))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *(pa.array(c, arrow[t]) for c, (_, t) in zip(cols, out))],
                names=[*kept, *(c for c, _ in out)])

    text = F.col(text_col).cast("string").alias("__text")
    return docs.select(text, *[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)
