"""Ranked lexical search with hashed max-sketches and exact rescoring.

``score(query, document) = sum of weight(term) * impact(term, document)`` over the query's distinct
terms, where impact grows with the term's occurrences and shrinks with the document's length
(saturating, in integers).

1. The queries' distinct terms are a table (query, term hash). Which hash slots they take is a table
   of ``FILTER`` bits, fixed in size however many queries there are.
2. One pass over the documents: each row's number of terms, and term hashes with occurrences for
   the terms whose slot some query takes; others can't add to any score. The written table gives
   the corpus counts, the terms' document frequencies and so the weights.
3. Documents are packed into blocks. Each document's impacts, rounded up to 8 bits, fold into a
   sketch of ``COORDS`` coordinates: a coordinate holds the largest impact of the terms hashed to it.
4. Blocks of documents meet blocks of queries on a lane (each query block is sent once to each
   lane). A batched look-up of all queries' coordinates, a product of the sketches with the queries'
   summed weights, gives an upper bound for each pair. In descending order of the bounds the pairs are
   scored exactly, until the next bound is below the query's k-th score so far; that threshold is
   kept from block to block within a task.
5. The best k of each task are merged per query.

Defined cases: null and empty texts, or those without terms, count nothing and are found by nothing; rows
of one id are documents of their own; rows with a null id count in the statistics but are never
returned; queries of one id are one query with the terms of all its rows, those with a null id or without
terms give no rows; equal scores go by ascending id; a text of any length is handled whole; empty tables
give an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import grid
from .common import WORD_BYTES, WordHashes, written

TOP = 10
#: Fixed values of the score: weights and impacts are integers in these units.
WEIGHT_UNIT, IMPACT_UNIT, SATURATION, LENGTH_PERCENT = 1000, 1_000_000_000, 8, 90
FILTER = 1 << 22
COORDS = 1024
BLOCK_DOCS = 1024
BLOCK_QUERIES = 256
#: Largest impact and the value of a sketch step; 255 steps reach it.
_MOST, _STEP = IMPACT_UNIT // 1000, -(-IMPACT_UNIT // 1000 // 255)
#: Queries whose best documents a task holds; with more it passes on what it has and starts afresh.
HELD_QUERIES = 50_000


class Terms(WordHashes):
    """bytes -> signed 64-bit hash of a term, 0 if its slot is not in ``slots``."""

    def __init__(self, slots: np.ndarray | None = None):
        super().__init__()
        self.slots = slots

    def __missing__(self, word: bytes) -> int:
        h = super().__missing__(word)
        h = h - (1 << 64) if h >> 63 else h
        if self.slots is not None and not self.slots[h % FILTER]:
            h = 0
        self[word] = h
        return h


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query_id, term), each pair once."""

    def run(batches):
        hashes = Terms()
        for batch in batches:
            ids, found = [], []
            for query_id, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                terms = {hashes[w] for w in (data.as_py() or b"").translate(WORD_BYTES).split()}
                ids += [query_id] * len(terms)
                found += terms
            hashes.trim()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], names=["query_id", "term"])

    texts = queries.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary"))
    return texts.filter(texts[0].isNotNull()).mapInArrow(run, "query_id long, term long").distinct()


def taken_slots(terms: DataFrame) -> np.ndarray:
    """A bit per slot: whether a query's term hashes to it. At most FILTER numbers reach the driver."""
    got = terms.select(F.pmod("term", F.lit(FILTER)).cast("int").alias("slot")).distinct().toArrow()
    slots = np.zeros(FILTER, bool)
    slots[got.column("slot").to_numpy()] = True
    return np.packbits(slots)


def indexed(docs: DataFrame, id_col: str, text_col: str, packed_slots: np.ndarray) -> DataFrame:
    """doc_id, n (all terms), terms and times (those of taken slots, each once) of every row with a term."""

    def run(batches):
        hashes = Terms(np.unpackbits(packed_slots).astype(bool))
        for batch in batches:
            n, terms, times = [], [], []
            for data in batch.column(1):
                words = (data.as_py() or b"").translate(WORD_BYTES).split()
                h = np.fromiter(map(hashes.__getitem__, words), np.int64, len(words))
                t, c = np.unique(h[h != 0], return_counts=True)
                n.append(len(words))
                terms.append(t)
                times.append(c)
                hashes.trim()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int64())),
                 pa.array(times, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "times"])

    texts = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary"))
    return texts.mapInArrow(run, "doc_id long, n long, terms array<long>, times array<long>").filter("n > 0")


def weighted(terms: DataFrame, index: DataFrame, total: int) -> DataFrame:
    """(query_id, term, weight) of the terms that stand in a document and weigh something."""
    df = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(WEIGHT_UNIT * F.ln(F.lit(2.0 * total + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    return terms.join(df, "term").select("query_id", "term", weight.alias("weight")).filter("weight > 0")


def doc_blocks(index: DataFrame, total: int, all_terms: int) -> DataFrame:
    """Blocks of at most BLOCK_DOCS documents: ids, offsets, terms, impacts, and the sketches."""

    def block(parts):
        ids, n, lens, terms, times = (np.concatenate(x) for x in zip(*parts))
        norm = 100 - LENGTH_PERCENT + LENGTH_PERCENT * n * total // all_terms
        doc = np.repeat(np.arange(len(ids)), lens)
        impacts = IMPACT_UNIT * times // (1000 * times + SATURATION * norm[doc])
        sketch = np.zeros(len(ids) * COORDS, np.uint8)
        np.maximum.at(sketch, doc * COORDS + coordinate(terms), (-(-impacts * 255 // _MOST)).astype(np.uint8))
        offsets = np.concatenate([[0], np.cumsum(lens)])
        cols = (ids.astype("<i8"), offsets.astype("<i8"), terms.astype("<i8"), impacts.astype("<i4"), sketch)
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in cols], names=_BLOCK)

    def run(batches):
        parts, have = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_DOCS):
                some = batch.slice(at, BLOCK_DOCS)
                while some.num_rows:
                    part = some.slice(0, BLOCK_DOCS - have)
                    some = some.slice(part.num_rows)
                    parts.append((part.column(0).to_numpy(), part.column(1).to_numpy(),
                                  part.column(2).value_lengths().to_numpy(zero_copy_only=False),
                                  part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()))
                    have += part.num_rows
                    if have == BLOCK_DOCS:
                        yield block(parts)
                        parts, have = [], 0
        if have:
            yield block(parts)

    return index.filter("doc_id is not null and size(terms) > 0").mapInArrow(run, ", ".join(f"{c} binary" for c in _BLOCK))


_BLOCK = ["ids", "offsets", "terms", "impacts", "sketch"]


def coordinate(terms: np.ndarray) -> np.ndarray:
    return (terms >> 40) & (COORDS - 1)


def query_blocks(weights: DataFrame) -> DataFrame:
    """About BLOCK_QUERIES queries in a row: an array of (query_id, term, weight)."""
    n = weights.select("query_id").distinct().count()
    lane = F.pmod(F.xxhash64("query_id"), F.lit(-(-max(n, 1) // BLOCK_QUERIES)))
    return weights.groupBy(lane.alias("block")).agg(
        F.collect_list(F.struct("query_id", "term", "weight")).alias("entries")).select("entries")


class Best:
    """The k best (score, id) of each query so far, best first; equal scores by ascending id."""

    def __init__(self, k: int):
        self.k, self.of = k, {}

    def threshold(self, query: int) -> int:
        """Scores from this on may still count."""
        scores = self.of.get(query, ((), ()))[0]
        return int(scores[-1]) if len(scores) == self.k else 1

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if query in self.of:
            scores, ids = np.append(self.of[query][0], scores), np.append(self.of[query][1], ids)
        order = np.lexsort((ids, -scores))[: self.k]
        self.of[query] = scores[order], ids[order]

    def drain(self) -> pa.RecordBatch:
        query = np.repeat(np.array(list(self.of), np.int64), [len(s) for s, _ in self.of.values()])
        scores, ids = (np.concatenate([np.zeros(0, np.int64), *(x[c] for x in self.of.values())]) for c in (0, 1))
        self.of = {}
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids), pa.array(scores)], names=["query_id", "doc_id", "score"])


class Lookup:
    """A block of queries, ready to be looked up in sketches."""

    def __init__(self, entries):
        query, term, weight = (entries.field(c).to_numpy(zero_copy_only=False) for c in ("query_id", "term", "weight"))
        order = np.lexsort((term, query))
        query, self.term, self.weight = query[order], term[order], weight[order]
        self.ids, start = np.unique(query, return_index=True)
        self.cut = np.append(start, len(query))
        self.sums = np.zeros((COORDS, len(self.ids)))  # exact: below 2^53
        np.add.at(self.sums, (coordinate(self.term), np.repeat(np.arange(len(self.ids)), np.diff(self.cut))), self.weight * _STEP)

    def search(self, ids, offsets, terms, impacts, sketch, best: Best) -> None:
        bounds = (sketch.astype(np.float64) @ self.sums).astype(np.int64)
        for j, query in enumerate(self.ids.tolist()):
            bound = bounds[:, j]
            some = np.flatnonzero(bound >= best.threshold(query))
            some = some[np.argsort(-bound[some], kind="stable")]
            mine, weight = self.term[self.cut[j]: self.cut[j + 1]], self.weight[self.cut[j]: self.cut[j + 1]]
            at, size = 0, 2 * best.k
            while at < len(some) and bound[some[at]] >= best.threshold(query):
                docs = some[at: at + size]
                lens = offsets[docs + 1] - offsets[docs]
                flat = np.repeat(offsets[docs] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
                where = np.minimum(np.searchsorted(mine, terms[flat]), len(mine) - 1)
                held = np.where(mine[where] == terms[flat], weight[where], 0) * impacts[flat]
                exact = np.bincount(np.repeat(np.arange(len(docs)), lens), held, len(docs)).astype(np.int64)
                hit = exact >= best.threshold(query)
                if hit.any():
                    best.add(query, exact[hit], ids[docs[hit]])
                at, size = at + size, 2 * size


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """query_id, rank (from 1), doc_id, score: the ``k`` best documents with a score above 0 of each query."""
    terms = written(query_terms(queries, query_id, query_text), "query-terms")
    index = written(indexed(docs, id_col, text_col, taken_slots(terms)), "index")
    total, all_terms = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = written(weighted(terms, index, total), "weights")

    def run(batches):
        best, entries, lookup = Best(k), None, None
        for batch in batches:
            for i in range(batch.num_rows):
                ids, offsets, postings, impacts, sketch = (batch.column(c)[i].as_buffer() for c in range(5))
                found = batch.column(5)[i].values
                if lookup is None or not found.equals(entries):
                    entries, lookup = found, Lookup(found)
                ids = np.frombuffer(ids, "<i8")
                lookup.search(ids, np.frombuffer(offsets, "<i8"), np.frombuffer(postings, "<i8"),
                              np.frombuffer(impacts, "<i4").astype(np.int64),
                              np.frombuffer(sketch, np.uint8).reshape(len(ids), COORDS), best)
                if len(best.of) > HELD_QUERIES:
                    yield best.drain()
        yield best.drain()

    pairs = grid(doc_blocks(index, total, max(1, all_terms)), query_blocks(weights), hint="merge").select(*_BLOCK, "q_entries")
    found = pairs.mapInArrow(run, "query_id long, doc_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
