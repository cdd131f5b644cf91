"""Approximate nearest neighbours from randomly rotated one-bit codes.

Every vector is scaled to length 1, padded to ``code_bits`` dimensions and rotated by a fixed
random rotation; its code is the sign of each coordinate, packed into bits, with two correction
scalars: the vector's length and ``c = <code / sqrt(D), rotated>``. The query is rotated alike and
rounded to ``query_bits`` bits per coordinate, so that the inner product of code and query is a
sum of popcounts of ANDed words over the query's bit planes. ``<code, query> / c`` estimates the
inner product with an error below

    epsilon * sqrt(1 - c^2) / c / sqrt(D - 1) * |query|

(plus the rounding's own error) with high probability. In each block, the rows of the largest
estimates (``FIRST * k``) are scored by the exact inner product of the original vectors, summed in
component order in double precision; then every other row whose upper bound reaches the k-th largest
score so far is. Blocks are merged by a per-query top-k.

The rotation depends on the dimension and seed only, so nothing is fitted; every row is indexed.

Defined cases: rows with a null id, or a vector that is null, zero, or holds a null or non-finite
component take no part; repeated ids: a query is asked once (smallest vector) and never gets rows
of its own id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .blocks import finite, grid, lanes_for, packed, query_blocks, unpacked
from .common import written

K = 20
EPSILON = 3.0
QUERY_BITS = 6
CODE_WORDS = 2  # 64-bit words of a code at least; more for longer vectors
BLOCK_ROWS = 8192
QUERY_ROWS = 256
FIRST = 5  # times k: rows scored first, for a threshold near the k-th score
CODE_ROWS = 256  # codes estimated at a time, so that the counts stay in the processor's cache
SEED = 20240501
INDEX = "ids binary, dim int, data binary, codes binary, norm binary, c binary"
RESULT = "query_id long, vec_id long, score double"


def rotation(bits: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix (QR of a Gaussian one)."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return q * np.sign(np.diag(r))


def _rotated(data: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((data * data).sum(axis=1))
    return norm, (data / norm[:, None]) @ turn[: data.shape[1]]


def encode(data: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes as uint64 words, lengths, correction c) of row vectors."""
    norm, x = _rotated(data, turn)
    codes = np.packbits(x > 0, axis=1, bitorder="little").view("<u8")
    return codes, norm, np.abs(x).sum(axis=1) / np.sqrt(len(turn))


def estimate(codes, norm, c, queries, turn, query_bits=QUERY_BITS, epsilon=EPSILON):
    """(estimate, error bound) of the inner products, both queries x rows."""
    bits = len(turn)
    q_norm, y = _rotated(queries, turn)
    low = y.min(axis=1, keepdims=True)
    step = np.maximum((y.max(axis=1, keepdims=True) - low) / (2 ** query_bits - 1), 1e-12)
    level = np.rint((y - low) / step).astype(np.uint64)
    planes = [np.packbits(((level >> np.uint64(plane)) & np.uint64(1)).astype(bool), axis=1,
                          bitorder="little").view("<u8") for plane in range(query_bits)]
    total = np.empty((len(queries), len(codes)), np.int32)
    for at in range(0, len(codes), CODE_ROWS):
        words = np.ascontiguousarray(codes[at:at + CODE_ROWS].T)
        count = np.zeros((len(queries), words.shape[1]), np.int32)
        both, ones = np.empty(count.shape, np.uint64), np.empty(count.shape, np.uint8)
        for plane in reversed(planes):
            count += count
            for w, word in enumerate(words):
                np.bitwise_and(plane[:, w, None], word, out=both)
                np.bitwise_count(both, out=ones)
                count += ones
        total[:, at:at + CODE_ROWS] = count
    ones = np.bitwise_count(codes).sum(axis=1)
    # <code, query>: coordinates are +-1 / sqrt(D); sum(sign * y) = 2 * sum over set bits - sum over all
    in_set = step * total + low * ones[None, :]
    dot = (2 * in_set - (step * level + low).sum(axis=1, keepdims=True)) / np.sqrt(bits)
    scale = q_norm[:, None] * norm[None, :]
    spread = np.sqrt(np.maximum(0.0, 1 - c * c)) / c / np.sqrt(bits - 1)
    rounding = step / np.sqrt(12.0) / c[None, :]
    return dot / c[None, :] * scale, epsilon * (spread[None, :] + rounding) * scale


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner product of each row of ``a`` with ``b``, summed in component order in double precision."""
    out = np.zeros(len(a))
    for column, x in zip(np.ascontiguousarray(a.T), b):
        out += column * x
    return out


def nearest(ids, data, q, est, err, mine, k):
    """(ids, scores) of the k nearest among the rows ``mine`` of a block, by estimates and error bounds."""
    first = mine
    if len(mine) > FIRST * k:
        first = mine[np.argpartition(-est[mine], FIRST * k - 1)[:FIRST * k]]
    near, score = first, dots(data[first], q)
    if len(first) < len(mine):
        bar = -np.partition(-score, k - 1)[k - 1]
        hopeful = est + err >= bar
        hopeful[first] = False
        more = mine[hopeful[mine]]
        near, score = np.concatenate([first, more]), np.concatenate([score, dots(data[more], q)])
    best = np.lexsort((ids[near], -score))[:k]
    return ids[near][best], score[best]


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
           k: int = K, epsilon: float = EPSILON, query_bits: int = QUERY_BITS, code_words: int = CODE_WORDS,
           block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row of ``queries``."""

    def usable(df):
        return df.filter(F.col(id_col).isNotNull() & finite(vec_col)
                         & F.exists(vec_col, lambda x: x != 0)).select(id_col, vec_col)

    def build(batches):
        turns = {}
        for batch in batches:
            for row in batch.to_pylist():
                _, data = unpacked(row["ids"], row["dim"], row["data"])
                words = max(code_words, -(-row["dim"] // 64))
                turn = turns.setdefault(words, rotation(64 * words, seed))
                codes, norm, c = encode(data, turn)
                yield pa.RecordBatch.from_pylist([row | {
                    "codes": codes.tobytes(), "norm": norm.tobytes(), "c": c.tobytes()}], schema=_INDEX)

    def probe(batches):
        turns = {}
        for batch in batches:
            for row in batch.to_pylist():
                ids, data = unpacked(row["ids"], row["dim"], row["data"])
                q_ids, q_data = unpacked(row["q_ids"], row["q_dim"], row["q_data"])
                norm, c = np.frombuffer(row["norm"]), np.frombuffer(row["c"])
                codes = np.frombuffer(row["codes"], "<u8").reshape(len(ids), -1)
                words = codes.shape[1]
                turn = turns.setdefault(words, rotation(64 * words, seed))
                # components beyond the block's own dimension meet only zeros there
                seen = q_data[:, : max(row["dim"], 1)]
                live = (seen != 0).any(axis=1)
                est, err = estimate(codes, norm, c, np.where(live[:, None], seen, 1.0), turn, query_bits, epsilon)
                out = []
                for i, q in enumerate(q_ids):
                    mine = np.flatnonzero(ids != q)
                    # a query of zeros here scores 0 with every row: an endless bound lets all in
                    bound = err[i] if live[i] else np.full(len(ids), np.inf)
                    out.append((q, *nearest(ids, data, q_data[i], est[i], bound, mine, k)))
                yield pa.RecordBatch.from_pydict({
                    "query_id": np.repeat(q_ids, [len(i) for _, i, _ in out]),
                    "vec_id": np.concatenate([i for _, i, _ in out]).astype(np.int64),
                    "score": np.concatenate([s for _, _, s in out]).astype(np.float64)})

    index = written(packed(usable(vectors), id_col, vec_col, block_rows).mapInArrow(build, INDEX), "codes")
    pairs = grid(index, query_blocks(usable(queries), id_col, vec_col, query_rows), lanes_for(index), hint="merge")
    found = pairs.mapInArrow(probe, RESULT)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


_INDEX = pa.schema([("ids", pa.binary()), ("dim", pa.int32()), ("data", pa.binary()),
                    ("codes", pa.binary()), ("norm", pa.binary()), ("c", pa.binary())])
