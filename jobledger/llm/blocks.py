"""Vectors packed into blocks, and the block grid of a stated query set against all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions_for, written

BLOCK = "ids binary, dim int, data binary"


def finite(vec: str) -> Column:
    """True for a vector that is not null and holds only finite components."""
    inf = float("inf")
    return F.col(vec).isNotNull() & F.coalesce(
        F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (x < F.lit(inf)) & (x > F.lit(-inf))), F.lit(False))


def packed(df: DataFrame, id_col: str, vec_col: str, rows: int) -> DataFrame:
    """Blocks of at most ``rows`` vectors (little-endian int64 ids, row-major float64 data).

    Each task packs the rows of its own partition, so nothing is shuffled and no task
    holds more than one block. Shorter vectors of a block are padded with zeros, which
    leaves inner products as they are.
    """

    def pack(batches):
        ids, vecs, have = [], [], 0

        def block():
            nonlocal ids, vecs, have
            lens = np.concatenate([np.diff(o) for o, _ in vecs])
            dim = max(1, int(lens.max()))
            out = np.zeros((have, dim))
            at = 0
            for off, flat in vecs:
                n = len(off) - 1
                width = np.diff(off)
                row = np.repeat(np.arange(at, at + n), width)
                col = np.arange(off[0], off[-1]) - np.repeat(off[:-1], width)
                out[row, col] = flat
                at += n
            made = pa.RecordBatch.from_pydict({
                "ids": pa.array([np.concatenate(ids).astype("<i8").tobytes()], pa.binary()),
                "dim": pa.array([dim], pa.int32()),
                "data": pa.array([out.astype("<f8").tobytes()], pa.binary())})
            ids, vecs, have = [], [], 0
            return made

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, min(rows - have, batch.num_rows - at))
                at += part.num_rows
                have += part.num_rows
                lists = part.column(1)
                off = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
                ids.append(part.column(0).to_numpy(zero_copy_only=False))
                vecs.append((off.astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)))
                if have == rows:
                    yield block()
        if have:
            yield block()

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")) \
             .mapInArrow(pack, BLOCK)


def unpacked(ids: bytes, dim: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(data, "<f8").reshape(-1, dim)


def one_per_id(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """One row per id: of repeated rows the smallest vector."""
    return df.groupBy(id_col).agg(F.min(vec_col).alias(vec_col))


def lanes_for(index: DataFrame) -> int:
    """Lanes for a written index: no more than it has blocks, as each lane costs a copy of the queries."""
    return max(1, min(max(8, partitions_for(index)), index.count()))


def grid(index: DataFrame, queries: DataFrame, lanes: int | None = None, hint: str | None = None) -> DataFrame:
    """Every (index block, query block) pair, dealt over ``lanes`` groups of index blocks.

    Index blocks are spread over the lanes at random and each query block is sent once to
    every lane, so the pairs come from an equi-join on the lane: the work is that of a
    stated query set against all rows, in blocks, and a task holds one pair at a time.
    The copies are made one by one, as an explode holds all those of a block in memory at once.
    ``hint``: a join hint for the queries' side, whose size after its repetition Spark can't estimate.
    """
    lanes = lanes or max(8, partitions_for(index))
    names = ["lane", *[f"q_{c}" for c in queries.columns]]

    def dealt(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1).columns
                for lane in range(lanes):
                    yield pa.RecordBatch.from_arrays([pa.array([lane], pa.int32()), *block], names=names)

    left = index.withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int"))
    right = queries.mapInArrow(dealt, T.StructType([T.StructField("lane", T.IntegerType())] + [
        T.StructField(f"q_{f.name}", f.dataType) for f in queries.schema]))
    return left.join(right.hint(hint) if hint else right, "lane")


def query_blocks(df: DataFrame, id_col: str, vec_col: str, rows: int) -> DataFrame:
    """Packed blocks of the queries, gathered from all partitions first so that blocks fill up."""
    one = one_per_id(df, id_col, vec_col)
    return written(packed(one, id_col, vec_col, rows), "query-blocks")
