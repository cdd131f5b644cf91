"""Versioned table: versions stay readable, untouched buckets keep their files, lost races change nothing."""

import os

import pytest
from pyspark.sql import functions as F

from jobledger.operators import jobs
from jobledger.sources.versioned import CommitConflict, VersionedTable


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(200).select("id", (F.col("id") % 40).alias("user_id"), F.lit("Applied").alias("status"))
    return VersionedTable.create(rows, f"{tmp_path}/jobs", ["user_id"], 8)


def changes(spark, rows):
    return spark.createDataFrame(rows, "id long, user_id long, status string, seq int")


def files(table, version):
    return {b: sorted(f for f in os.listdir(folder) if f.endswith(".parquet"))
            for b, folder in table.manifest(version)["folders"].items()}


def test_a_change_rewrites_its_buckets_only(spark, table):
    assert table.apply(changes(spark, [(3, 3, "Offer", 1), (4, 9, "Offer", 1), (5, 5, "", 1)]), jobs.set_status) == 1
    assert table.apply(changes(spark, [(43, 3, None, 1)]), jobs.delete_jobs) == 2
    assert table.versions() == [0, 1, 2]
    status = [{r.id: r.status for r in table.read(v).collect()} for v in (0, 1, 2)]
    assert set(status[0].values()) == {"Applied"} and len(status[0]) == 200
    assert {k for k, s in status[1].items() if s == "Offer"} == {3}  # 4 belongs to another owner
    assert set(status[1]) - set(status[2]) == {43}
    first, second, third = (table.manifest(v)["folders"] for v in (0, 1, 2))
    assert 0 < sum(first[b] != second[b] for b in first) <= 3 and sum(second[b] != third[b] for b in second) == 1
    for b in first:
        if first[b] == second[b]:
            assert files(table, 0)[b] == files(table, 1)[b]


def test_a_lost_race_is_refused_and_changes_nothing(spark, table):
    other = VersionedTable(spark, table.path)
    one, two = changes(spark, [(3, 3, "Offer", 1)]), changes(spark, [(3, 3, "Rejected", 1)])
    table.apply(one, jobs.set_status, version=0)
    with pytest.raises(CommitConflict):
        other.apply(two, jobs.set_status, version=0)
    assert table.versions() == [0, 1] and table.read().where("id = 3").first().status == "Offer"
    assert other.apply(two, jobs.set_status) == 2 and other.read().where("id = 3").first().status == "Rejected"


def test_buckets_may_empty_and_fill(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "Applied"), (2, 1, "Applied")], "id long, user_id long, status string")
    table = VersionedTable.create(rows, f"{tmp_path}/t", ["user_id"], 4)
    table.apply(rows.withColumn("seq", F.lit(1)), jobs.delete_jobs)
    assert table.read().count() == 0 and table.manifest()["folders"] == {} and table.read(0).count() == 2
    table.apply(rows, lambda have, new: have.unionByName(new))
    assert sorted(r.id for r in table.read().collect()) == [1, 2]
    empty = VersionedTable.create(rows.where("false"), f"{tmp_path}/e", ["user_id"], 4)
    assert empty.read().count() == 0 and empty.apply(rows, lambda have, new: new) == 1 and empty.read().count() == 2


def test_a_change_must_keep_its_keys(spark, table):
    with pytest.raises(ValueError):
        table.apply(changes(spark, [(3, 3, "x", 1)]), lambda rows, _: rows.withColumn("user_id", F.col("id") * 7))
    assert table.versions() == [0]
