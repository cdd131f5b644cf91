"""Periodic runs of words, found by internal pattern matching over a suffix array.

A run is a stretch of words with smallest period q (words q apart are identical), at least
``max(min_words, 3 * q)`` words long, that no neighbouring word extends keeping period q.

Many texts are handled together; words carry their text's number, so equal words of different
texts differ, and every text ends in a word of its own.

1. Prefix doubling ranks the stretches of 1, 2, 4, ... words that begin at each position; only
   positions whose stretch occurs again in their text go on to the next length. The last ranks
   are the order of the suffixes.
2. A wavelet tree over the suffix array (of the positions whose first ``block`` words occur
   again) answers range successor: the first occurrence at or after a position among the
   suffixes that begin with given words.
3. For every length 2^k from ``block`` on, each dyadic block at i asks for its occurrences in
   the neighbouring window [i + 2^k, i + 2^(k+1)), the shortest blocks also in [i + 1, i + block).
   A run of period q in such a window, being 3 q long, holds a whole dyadic block and the
   block's copy q words on. Occurrences whose starts lie within one block length form an
   arithmetic progression, so the first, the second and their number give all candidate periods.
4. A candidate is extended both ways as far as words q apart are equal, comparing the ranks of
   1, 2, 4, ... words; stretches that are long enough remain, each with its smallest period.

Candidates of one block length are at most as many as words, so the work is n log n for any text.
Nothing is shuffled: a text is handled by the task that reads it.

Defined cases: null and empty texts have no words and no runs; rows with a null or repeated id are
handled each on its own; a text of any length is handled whole; of several periods of one stretch the
smallest counts; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 24
TIMES = 3
#: Words handled together at least, if there are as many; a longer text is handled alone.
TOGETHER = 1 << 17

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Numbers(dict):
    """word -> number, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


class WaveletTree:
    """Rank and selection among the values of a range of an array, a level per bit."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            low = (values >> b) & 1 == 0
            zeros = np.concatenate([[0], np.cumsum(low)])
            self.levels.append((b, zeros))
            values = np.concatenate([values[low], values[~low]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of [lo, hi) are smaller than x."""
        count = np.zeros(len(lo), np.int64)
        for b, zeros in self.levels:
            one = (x >> b) & 1 == 1
            z_lo, z_hi = zeros[lo], zeros[hi]
            count += np.where(one, z_hi - z_lo, 0)
            lo = np.where(one, zeros[-1] + lo - z_lo, z_lo)
            hi = np.where(one, zeros[-1] + hi - z_hi, z_hi)
        return count

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of [lo, hi) that has k smaller ones there. With ``below``: the range successor."""
        value = np.zeros(len(lo), np.int64)
        for b, zeros in self.levels:
            z_lo, z_hi = zeros[lo], zeros[hi]
            one = k >= z_hi - z_lo
            value |= one.astype(np.int64) << b
            k = np.where(one, k - (z_hi - z_lo), k)
            lo = np.where(one, zeros[-1] + lo - z_lo, z_lo)
            hi = np.where(one, zeros[-1] + hi - z_hi, z_hi)
        return value


def ranks(codes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For k = 0, 1, ...: the rank of the 2^k codes from each position (equal stretches share one), and
    the positions whose stretch occurs more than once. The last ranks are all different."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    start = np.ones(n, bool)
    start[1:] = codes[order][1:] != codes[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    levels, repeated, step = [rank], [], 1
    last = np.append(start[1:], True)
    active = order[~(start & last)]
    while len(active):
        repeated.append(active)
        rank = levels[-1]
        key = rank[active] * n + rank[active + step]
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        old, at = rank[active], np.arange(len(active))
        first, start = np.ones(len(active), bool), np.ones(len(active), bool)
        first[1:] = old[1:] != old[:-1]
        start[1:] = key[1:] != key[:-1]
        rank = rank.copy()
        rank[active] = old + np.maximum.accumulate(np.where(start, at, 0)) - np.maximum.accumulate(np.where(first, at, 0))
        levels.append(rank)
        active = active[~(start & np.append(start[1:], True))]
        step *= 2
    return levels, repeated


def extended(levels: list[np.ndarray], i: np.ndarray, stop: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest [from, to) around [i, stop) of positions whose code equals that q on."""
    left, right, n = i.copy(), stop.copy(), len(levels[0])
    for k in range(len(levels) - 1, -1, -1):
        rank, size = levels[k], 1 << k
        inside = right + q < n
        same = inside & (rank[np.where(inside, right, 0)] == rank[np.where(inside, right + q, 1)])
        right = np.where(same, right + size, right)
        at = np.maximum(left - size, 0)
        same = (left >= size) & (rank[at] == rank[at + q])
        left = np.where(same, left - size, left)
    return left, right


def runs_of(codes: np.ndarray, begin: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """(start, length, period) of all runs, by start and period. ``begin``: of the text of each position."""
    base = max(0, ((min_words - min_words // TIMES + 1) // 2).bit_length() - 1)
    levels, repeated = ranks(codes)
    if len(repeated) <= base:
        return np.zeros((0, 3), np.int64)
    n = len(codes)
    suffixes = repeated[base][np.argsort(levels[-1][repeated[base]])]
    tree = WaveletTree(suffixes, n.bit_length())
    found = []
    for k in range(base, len(repeated)):
        size, rank = 1 << k, levels[k]
        blocks = repeated[k][(repeated[k] - begin[repeated[k]]) % size == 0]
        by_rank = rank[suffixes]
        lo, hi = (np.searchsorted(by_rank, rank[blocks], side) for side in ("left", "right"))
        windows = [(size, 2 * size)] if k > base else [(1, size), (size, 2 * size)]
        for near, far in windows:
            before = tree.below(lo, hi, np.minimum(blocks + near, n))
            times = tree.below(lo, hi, np.minimum(blocks + far, n)) - before
            some = np.flatnonzero(times)
            if not len(some):
                continue
            a, b, c, m = lo[some], hi[some], before[some], times[some]
            first = tree.kth(a, b, c)
            second = np.where(m > 1, tree.kth(a, b, np.where(m > 1, c + 1, c)), first)
            nth = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            i = np.repeat(blocks[some], m)
            q = np.repeat(first - blocks[some], m) + nth * np.repeat(second - first, m)
            order = np.lexsort((i, q))  # of adjoining blocks with one period the first tells all
            i, q = i[order], q[order]
            new = np.ones(len(i), bool)
            new[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1] + size)
            i, q = i[new], q[new]
            left, right = extended(levels, i, i + size, q)
            length = right - left + q
            long = length >= np.maximum(min_words, TIMES * q)
            found.append(np.unique(np.stack([left, length, q], axis=1)[long], axis=0))
    got = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
    smallest = np.ones(len(got), bool)  # of the periods of one stretch
    smallest[1:] = (got[1:, :2] != got[:-1, :2]).any(axis=1)
    got = got[smallest]
    return got[np.lexsort((got[:, 2], got[:, 0]))]


def runs_of_texts(texts: list[list[bytes]], min_words: int) -> list[np.ndarray]:
    """The runs of each of some texts, given as words."""
    numbers = Numbers()
    lens = np.array([len(x) for x in texts], np.int64)
    stop = np.cumsum(lens + 1)
    start = stop - lens - 1
    codes = np.zeros(int(stop[-1]) if len(stop) else 0, np.int64)
    for at, words in zip(start.tolist(), texts):
        codes[at: at + len(words)] = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    text = np.repeat(np.arange(len(texts)), lens + 1)
    runs = runs_of(codes + text * (len(numbers) + 1), start[text], min_words)
    cut = np.searchsorted(runs[:, 0], start)
    return [part - [at, 0, 0] for at, part in zip(start, np.split(runs, cut[1:]))] if texts else []


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words but those of a run after its first period, joined by a blank."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row: the id, ``n_words``, ``runs`` (by start, then period) and the ``collapsed`` text."""

    def run(batches):
        for batch in batches:
            ids, texts, have, at = batch.column(0), [], 0, 0
            for k, data in enumerate(batch.column(1)):
                texts.append((data.as_py() or b"").split())  # bytes split at ASCII white space only
                have += len(texts[-1])
                if have >= TOGETHER or k == batch.num_rows - 1:
                    found = runs_of_texts(texts, min_words)
                    flat = np.concatenate(found)
                    structs = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(_RUN))
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(at, len(texts)), pa.array([len(x) for x in texts], pa.int64()),
                         pa.ListArray.from_arrays(offsets, structs),
                         pa.array([collapsed(x, r) for x, r in zip(texts, found)], pa.binary()).cast(pa.string())],
                        names=[id_col, "n_words", "runs", "collapsed"])
                    at, texts, have = k + 1, [], 0

    schema = (f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_words long, "
              "runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").cast("binary")).mapInArrow(run, schema)
