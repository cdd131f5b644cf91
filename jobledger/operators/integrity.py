"""Referential rules: orphans (FK violations), cascade delete, uniqueness violations.

``RELATIONS`` and ``UNIQUE`` declare the whole schema: the checks and deletes below walk them, so a further
relation or key is a line there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


class Relation(NamedTuple):
    """``child.fk`` names the ``id`` of a ``parent``; ``cascade``: a deleted parent takes its children along."""

    child: str
    fk: str
    parent: str
    cascade: bool = True

    @property
    def name(self) -> str:
        return f"{self.child}({self.fk})"


# --- fixed values -----------------------------------------------------------
RELATIONS = (
    Relation("api_keys", "user_id", "users"),
    Relation("applied_jobs", "user_id", "users"),
    Relation("progress", "user_id", "users"),
    Relation("user_status", "user_id", "users"),
    Relation("user_skills", "user_id", "users"),
    Relation("resume_settings", "user_id", "users"),
    Relation("users", "mentor_id", "mentors", cascade=False),
)
UNIQUE = (
    ("users", ("firebase_uid",)),
    ("users", ("email",)),
    ("api_keys", ("key",)),
    ("progress", ("user_id",)),
    ("mentors", ("email",)),
    ("session_notes", ("user_id", "call_number")),
    ("user_status", ("user_id",)),
    ("user_skills", ("user_id",)),
    ("resume_settings", ("user_id",)),
    ("freetrial_users", ("email",)),
)
# ---------------------------------------------------------------------------


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """Child rows whose non-null foreign key has no parent (anti join on the key)."""
    p = parent.select(F.col(pk).alias("_pk"))
    c = child.where(F.col(fk).isNotNull())
    return c.join(p, c[fk] == p._pk, "left_anti")


def cascade(child: DataFrame, deleted_parents: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """Child rows that survive deleting ``deleted_parents`` (on delete cascade)."""
    d = deleted_parents.select(F.col(pk).alias("_pk"))
    return child.join(d, child[fk] == d._pk, "left_anti")


def violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values held by more than one row (partial aggregation before the shuffle)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def broken_relations(tables: Mapping[str, DataFrame], relations: Sequence[Relation] = RELATIONS) -> DataFrame:
    """relation, child_id, fk of every child row whose non-null foreign key names no parent."""
    return _union([
        orphans(tables[r.child], tables[r.parent], r.fk).select(
            F.lit(r.name).alias("relation"), F.col("id").cast("string").alias("child_id"), F.col(r.fk).cast("string").alias("fk"))
        for r in relations])


def _levels(relations: Sequence[Relation]) -> list[str] | None:
    """Tables with parents before children, or None if the relations hold a cycle."""
    left = {t for r in relations for t in (r.child, r.parent)}
    order: list[str] = []
    while left:
        free = sorted(t for t in left if not any(r.child == t and r.parent in left for r in relations))
        if not free:
            return None
        order += free
        left -= set(free)
    return order


def deleted_with(tables: Mapping[str, DataFrame], gone: Mapping[str, DataFrame],
                 relations: Sequence[Relation] = RELATIONS) -> DataFrame:
    """table_name, id (as text) of all rows that go when the rows ``gone`` (by table, with ``id``) are deleted.

    Cascades pass from parents to children until nothing more goes. Without a cycle among the relations
    that is one lazy semi join per relation, parents first. With one, each round joins only the rows found
    last, and is checkpointed; as many rounds run as the longest chain of rows has links.
    """
    cascades = [r for r in relations if r.cascade]
    order = _levels(cascades)

    def ids(df: DataFrame) -> DataFrame:
        return df.select(F.col("id").cast("string").alias("id"))

    def children(r: Relation, parents: DataFrame) -> DataFrame:
        child = tables[r.child]
        return ids(child.join(parents.select(F.col("id").alias("_gone")), child[r.fk].cast("string") == F.col("_gone"), "left_semi"))

    def named(table: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(table).alias("table_name"), "id")

    if order is not None:
        dead: dict[str, DataFrame] = {}
        for t in [*order, *(t for t in gone if t not in order)]:
            parts = [ids(gone[t])] if t in gone else []
            parts += [children(r, dead[r.parent]) for r in cascades if r.child == t and r.parent in dead]
            if parts:
                dead[t] = _union(parts).distinct()
        return _union([named(t, df) for t, df in dead.items()])

    found = cut_lineage(_union([named(t, ids(df)) for t, df in gone.items()]).distinct())
    last = found
    while not last.isEmpty():
        step = _union([named(r.child, children(r, last.where(F.col("table_name") == r.parent))) for r in cascades])
        last = cut_lineage(step.distinct().join(found, ["table_name", "id"], "left_anti"))
        found = cut_lineage(found.unionByName(last))
    return found


def survivors(tables: Mapping[str, DataFrame], deleted: DataFrame, name: str) -> DataFrame:
    """Rows of a table that ``deleted`` (of ``deleted_with``) leaves."""
    d = deleted.where(F.col("table_name") == name).select(F.col("id").alias("_gone"))
    t = tables[name]
    return t.join(d, t["id"].cast("string") == F.col("_gone"), "left_anti")


def unique_violations(tables: Mapping[str, DataFrame],
                      keys: Sequence[tuple[str, Sequence[str]]] = UNIQUE) -> DataFrame:
    """relation, key_value, n of every key value that more than one row holds, for all keys at once.

    Each table is read once: a row emits a (relation, key) per key of its table, and one aggregate with a
    map-side step counts them. A key with a null column conflicts with nothing.
    """
    emitted = []
    for t in dict.fromkeys(t for t, _ in keys):
        own = [cols for name, cols in keys if name == t]
        rows = F.array(*[F.struct(F.lit(f"{t}({','.join(cols)})").alias("relation"),
                                  F.array(*[F.col(c).cast("string") for c in cols]).alias("k")) for cols in own])
        emitted.append(tables[t].select(F.inline(rows)).where(~F.exists("k", lambda x: x.isNull())))
    counted = _union(emitted).groupBy("relation", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return counted.select("relation", F.array_join("k", "|").alias("key_value"), "n")


def existing_tables(spark, names: Sequence[str]) -> list[str]:
    """Which of ``names`` exist in the current catalog."""
    have = {t.name for t in spark.catalog.listTables()}
    return [n for n in names if n in have]


def ensure_table(spark, name: str, ddl_schema: str, path: str | None = None) -> None:
    """Idempotent create (CREATE TABLE IF NOT EXISTS ... USING parquet)."""
    loc = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl_schema}) USING parquet{loc}")
