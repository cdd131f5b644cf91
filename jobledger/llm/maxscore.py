"""Exact top-k by inner product over integer term weights, with MaxScore.

Each component of a vector is a term whose weight is ``floor(scale * x)``; a block of
vectors is a shard with one posting list (column) per term and the list's largest and
smallest weight. For a query, term t adds at most ``U_t = max(q_t * hi_t, q_t * lo_t)``.
Terms are ordered by ``U_t``; those whose bounds sum to less than the threshold are
non-essential. The essential postings are traversed for all rows of the shard, then the
non-essential lists are probed in falling order of their bounds, only for rows whose
partial score plus the remaining bound still reaches the threshold. Shards are merged by
a per-query top-k.

Defined cases: rows with a null id, a null vector or a null / non-finite component take no
part; an empty vector scores 0 against everything; of repeated ids a query is asked once
(smallest vector), and a query never gets rows of its own id; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .blocks import finite, grid, lanes_for, packed, query_blocks, unpacked
from .common import written

SCALE = 256
K = 5
SHARD_ROWS = 8192
QUERY_ROWS = 1024
_SEED_ROWS = 256  # rows scored in full first, to start the threshold
RESULT = "query_id long, vec_id long, score long"


class Shard:
    """Posting lists of one block of vectors, and the bounds of each."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        self.ids = ids
        self.lists = np.asfortranarray(weights)
        self.hi = weights.max(axis=0)
        self.lo = weights.min(axis=0)

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows but those of id ``own``; ties to the smaller id."""
        query = query[: self.lists.shape[1]]
        terms = np.flatnonzero(query)
        lists, dim = self.lists, len(query)
        mine = self.ids != own
        if not mine.any():
            return self.ids[:0], np.zeros(0, np.int64)
        seed = np.flatnonzero(mine)[:_SEED_ROWS]
        threshold = _kth(lists[seed, :dim] @ query, k)
        bound = np.maximum(query * self.hi[:dim], query * self.lo[:dim])[terms]
        order = np.argsort(bound, kind="stable")
        terms, bound = terms[order], bound[order]
        rest = np.cumsum(bound)  # rest[i]: bound of the terms 0..i together
        split = 0
        if threshold is not None:
            split = int(np.searchsorted(rest >= threshold, True)) if (rest >= threshold).any() else len(terms)
        score = np.zeros(len(self.ids), np.int64)
        for t in terms[split:]:
            score += lists[:, t] * query[t]
        left = int(rest[split - 1]) if split else 0
        alive = np.flatnonzero(mine if threshold is None else mine & (score + left >= threshold))
        score = score[alive]
        if split and len(alive) > k:  # a better threshold: the most promising rows in full
            lead = alive[np.argpartition(-score, k - 1)[:k]]
            best = _kth(lists[lead, :dim] @ query, k)
            threshold = best if threshold is None else max(threshold, best)
        for i in range(split - 1, -1, -1):
            keep = score + left >= threshold
            alive, score = alive[keep], score[keep]
            left -= int(bound[i])
            score = score + lists[alive, terms[i]] * query[terms[i]]
        if threshold is not None:
            keep = score >= threshold
            alive, score = alive[keep], score[keep]
        ids = self.ids[alive]
        best = np.lexsort((ids, -score))[:k]
        return ids[best], score[best]


def _kth(scores: np.ndarray, k: int) -> int | None:
    return None if len(scores) < k else int(-np.partition(-scores, k - 1)[k - 1])


def _weights(data: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(data * scale).astype(np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
          k: int = K, scale: int = SCALE, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``vectors`` for each row of ``queries``."""

    def usable(df):
        return df.filter(F.col(id_col).isNotNull() & finite(vec_col)).select(id_col, vec_col)

    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, data = unpacked(row["ids"], row["dim"], row["data"])
                shard = Shard(ids, _weights(data, scale))
                q_ids, q_data = unpacked(row["q_ids"], row["q_dim"], row["q_data"])
                found = [(q, *shard.top(w, q, k)) for q, w in zip(q_ids, _weights(q_data, scale))]
                yield pa.RecordBatch.from_pydict({
                    "query_id": np.repeat(q_ids, [len(i) for _, i, _ in found]),
                    "vec_id": np.concatenate([i for _, i, _ in found]).astype(np.int64),
                    "score": np.concatenate([s for _, _, s in found]).astype(np.int64)})

    index = written(packed(usable(vectors), id_col, vec_col, shard_rows), "shards")
    pairs = grid(index, query_blocks(usable(queries), id_col, vec_col, query_rows), lanes_for(index), hint="merge")
    found = pairs.mapInArrow(search, RESULT)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
