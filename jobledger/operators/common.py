"""Shared set-wise building blocks, written to survive skewed keys.

* ``top_k_per_group`` filters ``row_number() <= k`` with a literal bound, which
  lets Spark insert a partial ``WindowGroupLimit`` below the shuffle (each map
  task keeps at most k rows per group); a per-row k is applied after that.
* ``first_per`` is the k = 1 case (one row per key), so a key holding a third
  of all rows is reduced inside every map task before the shuffle.

Joins carry no hints: the planner broadcasts a side by its size in bytes, at run
time too (AQE), and splits skewed partitions of the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], *,
              last: bool = False) -> DataFrame:
    """One row per ``keys``: the row with the smallest (``last``: largest) ``order`` tuple.

    ``row_number() <= 1`` with a literal bound: Spark plans a partial
    ``WindowGroupLimit`` below the shuffle, so each map task forwards at most one
    row per key and a key holding a third of all rows is reduced before the
    exchange. Nulls order lowest (first ascending, last descending).
    """
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    ordering = [c.desc_nulls_last() if last else c.asc_nulls_first() for c in cols]
    return top_k_per_group(df, keys, ordering, 1)


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k_max: int,
                    k: Column | None = None, rank_col: str | None = None) -> DataFrame:
    """Rows ranked 1..k within each group by ``order`` (ties must be broken by ``order``)."""
    rn = "_rn" if rank_col is None else rank_col
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) <= F.lit(k_max))
    if k is not None:
        out = out.where(F.col(rn) <= k)
    return out.drop("_rn") if rank_col is None else out
