"""Job-application tracking as batch changes: validate, dedup, merge, delete, re-status.

Plain parquet has no MERGE, so every change returns the *new table* as a
DataFrame; write it to a new path (or ``MERGE INTO`` with a table format).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import is_job_title
from ..functions.text import falsy_to_null
from .common import first_per

# --- fixed values -----------------------------------------------------------
REJECT_MISSING = "Title and URL are required"
REJECT_TITLE = ("Invalid job title. The title appears to be navigation or button text, not an actual "
                "job posting. Please ensure you are tracking an actual job posting.")
REJECT_NO_STATUS = "Status is required"
REJECT_NOT_FOUND = "Applied job not found"
DEFAULT_STATUS = "Applied"
DEFAULT_TYPE = "Website"
JOB_KEY = ("user_id", "url")
# ---------------------------------------------------------------------------


def reject_reason(title: Column, url: Column) -> Column:
    """Required fields first, then the title filter; null when the row is valid."""
    missing = title.isNull() | (title == "") | url.isNull() | (url == "")
    return F.when(missing, F.lit(REJECT_MISSING)).when(~is_job_title(title), F.lit(REJECT_TITLE))


def split_valid(incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reason)."""
    v = incoming.withColumn("reject_reason", reject_reason(F.col("title"), F.col("url")))
    return v.where(F.col("reject_reason").isNull()).drop("reject_reason"), v.where(F.col("reject_reason").isNotNull())


def normalize_job(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Falsy company/location/applied_text -> null, missing date -> as_of, status 'Applied'."""
    as_of = F.localtimestamp() if as_of is None else as_of
    return (df.withColumn("company", falsy_to_null(F.col("company")))
              .withColumn("location", falsy_to_null(F.col("location")))
              .withColumn("applied_text", falsy_to_null(F.col("applied_text")))
              .withColumn("applied_date", F.coalesce(F.col("applied_date"), as_of))
              .withColumn("status", F.lit(DEFAULT_STATUS)))


def fill_defaults(df: DataFrame) -> DataFrame:
    """Schema defaults for missing values (status, type)."""
    out = df
    for name, default in (("status", DEFAULT_STATUS), ("type", DEFAULT_TYPE)):
        c = F.col(name) if name in df.columns else F.lit(None).cast("string")
        out = out.withColumn(name, F.coalesce(c, F.lit(default)))
    return out


def first_tracked(jobs: DataFrame) -> DataFrame:
    """The first stored row per (user, url), by (applied_date, id)."""
    return first_per(jobs, JOB_KEY, ["applied_date", "id"])


def split_tracked(incoming: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(not yet tracked, already tracked) by (user_id, url)."""
    keys = existing.select(*JOB_KEY)
    return incoming.join(keys, list(JOB_KEY), "left_anti"), incoming.join(keys, list(JOB_KEY), "left_semi")


def merge_jobs(existing: DataFrame, incoming: DataFrame, as_of: Column | None = None,
               order: tuple[str, ...] = ("sub_id",), id_col: str = "sub_id"
               ) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Insert-if-absent batch. Returns (table, inserted, rejected, already_tracked).

    In-batch duplicates resolve like sequential requests: the first by ``order``
    (arrival order; make it total) is inserted, later ones are "already tracked".
    """
    valid, rejected = split_valid(incoming)
    firsts = first_per(valid, JOB_KEY, list(order)).select(*valid.columns)
    new = split_tracked(firsts, existing)[0].select(*valid.columns)
    # what is valid and was not inserted: an anti-join on the narrow arrival order, which has no hot value;
    # of rows equal in it one was inserted, the others are told apart by their number
    nth = F.row_number().over(Window.partitionBy(*JOB_KEY, *order).orderBy(F.lit(1)))
    same = [F.col(f"v.{c}").eqNullSafe(F.col(f"n.{c}")) for c in (*JOB_KEY, *order)]
    tracked = (valid.withColumn("_nth", nth).alias("v")
               .join(new.select(*JOB_KEY, *order).withColumn("_one", F.lit(1)).alias("n"),
                     [*same, F.col("v._nth") == F.col("n._one")], "left_anti").select(*valid.columns))
    inserted = normalize_job(new, as_of).withColumnRenamed(id_col, "id")
    table = existing.withColumn("origin", F.lit("existing")).unionByName(
        inserted.withColumn("origin", F.lit("new")), allowMissingColumns=True)
    return table, inserted, rejected, tracked


def split_owned(changes: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes whose (id, user_id) names a stored row, and those that do not (not found)."""
    keys = table.select("id", "user_id")
    return changes.join(keys, ["id", "user_id"], "left_semi"), changes.join(keys, ["id", "user_id"], "left_anti")


def change_outcomes(changes: DataFrame, table: DataFrame, kind: str = "status") -> DataFrame:
    """Per change request: null reason when applied, else the service's message.

    Status changes check the status first, then ownership; deletes check ownership.
    Ownership is a left join flag on (id, user_id), so each change is one output row.
    """
    owned = table.select("id", "user_id").distinct().withColumn("_owned", F.lit(True))
    j = changes.join(owned, ["id", "user_id"], "left")
    found = F.coalesce(F.col("_owned"), F.lit(False))
    reason = F.when(~found, F.lit(REJECT_NOT_FOUND))
    if kind == "status":
        reason = F.when(F.col("status").isNull() | (F.col("status") == ""), F.lit(REJECT_NO_STATUS)) \
            .otherwise(reason)
    return j.withColumn("reject_reason", reason).drop("_owned")


def delete_jobs(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Hard delete of rows named by (id, owner); other owners' requests change nothing."""
    return table.join(changes.select("id", "user_id"), ["id", "user_id"], "left_anti")


def set_status(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply non-empty status changes by (id, owner); the change with the largest ``seq`` per id wins."""
    if "seq" not in changes.columns:
        raise ValueError("status changes need an order column 'seq'")
    ok = changes.where(F.col("status").isNotNull() & (F.col("status") != ""))
    latest = first_per(ok.select("id", "user_id", "status", "seq"), ["id", "user_id"], ["seq", "status"], last=True)
    upd = latest.select("id", "user_id", F.col("status").alias("new_status"))
    out = table.join(upd, ["id", "user_id"], "left")
    return out.withColumn("status", F.coalesce(F.col("new_status"), F.col("status"))).drop("new_status")


def newest_first(jobs: DataFrame, user_id=None) -> DataFrame:
    """A user's jobs newest first; without ``user_id``, all users sorted (range-partitioned)."""
    if user_id is not None:
        jobs = jobs.where(F.col("user_id") == F.lit(user_id))
    return jobs.orderBy(F.col("user_id"), F.col("applied_date").desc(), F.col("id").desc())


def replay_changes(table: DataFrame, steps, checkpoint_every: int = 4,
                   as_of: Column | None = None, order: tuple[str, ...] = ("sub_id",)) -> DataFrame:
    """Apply a sequence of change batches in order: ("status", df) | ("delete", df) | ("insert", df).

    Each step builds on the previous table, so the plan grows with the number of
    steps; every ``checkpoint_every`` steps the table is checkpointed into the
    cluster's ``spark.checkpoint.dir`` (reliable storage, survives executor loss).
    """
    from ..session import cut_lineage
    for n, (kind, batch) in enumerate(steps, start=1):
        if kind == "status":
            table = set_status(table, batch)
        elif kind == "delete":
            table = delete_jobs(table, batch)
        elif kind == "insert":
            table = merge_jobs(table, batch, as_of, order=order)[0].drop("origin")
        else:
            raise ValueError(f"unknown change kind {kind!r}")
        if checkpoint_every and n % checkpoint_every == 0:
            table = cut_lineage(table)
    return table
