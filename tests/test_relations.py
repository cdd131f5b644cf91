"""Relation graph, uniqueness in one pass, calendar of usage."""

import datetime as dt

from pyspark.sql import functions as F

from core_helpers import SF_SMALL
from jobledger.operators import integrity, usage
from jobledger.operators.integrity import Relation
from jobledger.plans.fixtures import Views


def _rows(spark, pairs):
    return spark.createDataFrame(pairs, "id long, parent_id long")


def test_cascade_walks_every_level(spark):
    chain = {f"t{k}": _rows(spark, [(i, i // 2) for i in range(8)]) for k in range(4)}
    relations = [Relation(f"t{k + 1}", "parent_id", f"t{k}") for k in range(3)] + [
        Relation("t3", "id", "t0", cascade=False)]
    dead = integrity.deleted_with(chain, {"t0": chain["t0"].where("id = 0")}, relations)
    got = {}
    for r in dead.collect():
        got.setdefault(r.table_name, set()).add(int(r.id))
    assert got == {"t0": {0}, "t1": {0, 1}, "t2": {0, 1, 2, 3}, "t3": set(range(8))}
    assert integrity.survivors(chain, dead, "t2").count() == 4
    assert integrity.survivors(chain, dead, "t0").count() == 7


def test_cascade_through_a_cycle_of_relations(spark):
    tables = {"node": _rows(spark, [(i, i - 1) for i in range(1, 7)] + [(20, 21), (21, 20), (30, None)]),
              "leaf": _rows(spark, [(100 + i, i) for i in range(1, 7)])}
    relations = [Relation("node", "parent_id", "node"), Relation("leaf", "parent_id", "node")]
    dead = integrity.deleted_with(tables, {"node": tables["node"].where("id = 3 or id = 20")}, relations)
    assert sorted((r.table_name, int(r.id)) for r in dead.collect()) == sorted(
        [("node", i) for i in (3, 4, 5, 6, 20, 21)] + [("leaf", i) for i in (103, 104, 105, 106)])


def test_rows_without_a_foreign_key_or_with_repeated_parents_are_no_orphans(spark):
    tables = {"a": _rows(spark, [(1, None), (1, None), (2, None)]), "b": _rows(spark, [(10, 1), (11, None), (12, 9), (12, 9)])}
    got = integrity.broken_relations(tables, [Relation("b", "parent_id", "a")]).collect()
    assert sorted(map(tuple, got)) == [("b(parent_id)", "12", "9")] * 2


def test_uniqueness_reads_each_table_once_and_counts_partially(spark):
    v = Views(spark, SF_SMALL)
    plan = integrity.unique_violations(v.relations())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == len({t for t, _ in integrity.UNIQUE})
    assert "partial_count" in plan


def test_unique_keys_with_nulls_conflict_with_nothing(spark):
    t = spark.createDataFrame([(1, None), (1, None), (1, "a"), (1, "a"), (2, "a"), (None, "a")], "x int, y string")
    got = integrity.unique_violations({"t": t}, [("t", ("x", "y")), ("t", ("y",)), ("t", ("x",))]).collect()
    assert sorted(map(tuple, got)) == [("t(x)", "1", 4), ("t(x,y)", "1|a", 2), ("t(y)", "a", 4)]


def test_calendar_holds_every_day(spark):
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    audit = spark.createDataFrame(
        [(1, "/api/x", day(3, 5), None), (1, "/api/x", day(3, 6), None), (2, "/api/x", day(2), None), (9, "/api/x", day(2), None),
         (1, "/auth/x", day(4), None), (1, "/api/x", day(4), day(4))],
        "user_id long, path string, created_at timestamp_ntz, deleted_at timestamp_ntz")
    users = spark.createDataFrame([(1, day(2, 9)), (2, day(4)), (3, day(5)), (4, day(9))], "id long, created_at timestamp_ntz")
    as_of = F.lit(day(5, 1)).cast("timestamp_ntz")
    got = usage.usage_calendar(audit, users, as_of, limit=2)
    assert sorted((r.user_id, r.day.day, r.used, r.remaining, r.exceeded) for r in got.collect()) == [
        (1, 2, 0, 2, False), (1, 3, 2, 0, True), (1, 4, 0, 2, False), (1, 5, 0, 2, False),
        (2, 2, 1, 1, False), (2, 3, 0, 2, False), (2, 4, 0, 2, False), (2, 5, 0, 2, False), (3, 5, 0, 2, False)]
    last = usage.usage_calendar(audit, users, as_of, days=2)
    assert {(r.user_id, r.day.day) for r in last.collect()} == {(1, 4), (1, 5), (2, 4), (2, 5), (3, 5)}
