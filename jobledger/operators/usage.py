"""Usage metering: rolling and per-day counts of model-backed API calls vs a quota."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
DAILY_LIMIT = 20
ROLLING_DAYS = 20
API_PREFIX = "/api/"
EXCLUDED_PATH = "applied-jobs"
# ---------------------------------------------------------------------------


def not_deleted(df: DataFrame) -> DataFrame:
    return df.where(F.col("deleted_at").isNull())


def path_like(path: Column, prefix: str = API_PREFIX, exclude: str | None = None) -> Column:
    """``path LIKE prefix%`` (pushed to parquet as StringStartsWith) and optional NOT LIKE %exclude%."""
    cond = path.startswith(prefix)
    if exclude:
        cond = cond & ~path.contains(exclude)
    return cond


def api_calls(audit: DataFrame, exclude: str | None = None) -> DataFrame:
    """Live (not soft-deleted) calls under /api/.

    The per-user service filter names ``path`` twice, so as executed only the
    prefix applies (``exclude=None``); pass ``exclude='applied-jobs'`` for the
    documented intent (the raw rolling query applies both).
    """
    return not_deleted(audit).where(path_like(F.col("path"), exclude=exclude))


def day_of(ts: Column) -> Column:
    """Midnight of the (zone-free) day of ``ts``; same as a closed 00:00-23:59:59.999 range."""
    return F.to_date(ts).cast("timestamp_ntz")


def quota(used: Column, limit: int = DAILY_LIMIT) -> list[Column]:
    return [F.lit(limit).alias("daily_limit"),
            F.greatest(F.lit(0), F.lit(limit) - used).cast("bigint").alias("remaining"),
            (used >= limit).alias("exceeded")]


def usage_rolling(audit: DataFrame, as_of: Column | None = None, days: int = ROLLING_DAYS,
                  exclude: str | None = EXCLUDED_PATH) -> DataFrame:
    """One row ``n``: calls since ``as_of - days`` (no upper bound)."""
    as_of = F.localtimestamp() if as_of is None else as_of
    since = as_of - F.make_dt_interval(days=F.lit(days))
    return api_calls(audit, exclude).where(F.col("created_at") >= since).agg(F.count(F.lit(1)).alias("n"))


def usage_daily(audit: DataFrame, limit: int = DAILY_LIMIT, exclude: str | None = None) -> DataFrame:
    """Per (user, day) call count with remaining quota; anonymous calls belong to no user."""
    calls = api_calls(audit, exclude).where(F.col("user_id").isNotNull())
    counted = calls.groupBy("user_id", day_of(F.col("created_at")).alias("day")).agg(
        F.count(F.lit(1)).alias("used"))
    return counted.select("user_id", "day", "used", *quota(F.col("used"), limit))


def usage_calendar(audit: DataFrame, users: DataFrame, as_of: Column, days: int | None = None,
                   limit: int = DAILY_LIMIT, exclude: str | None = None) -> DataFrame:
    """Per user and day the call count and quota, days without calls included.

    A user's days go from sign-up (``created_at``) or the first call, whichever is earlier, to the day of ``as_of``,
    with ``days`` only the last so many of them. They are generated from the user's own row, so
    nothing is paired; the counts are aggregated before they are joined.
    """
    counted = usage_daily(audit, limit, exclude).select(F.col("user_id").alias("_user"), F.col("day").alias("_day"), "used")
    first = counted.groupBy("_user").agg(F.min("_day").alias("_first"))
    last = day_of(as_of)
    start = F.least(day_of(F.col("created_at")), F.col("_first"))
    if days is not None:
        start = F.greatest(start, last - F.make_dt_interval(days=F.lit(days - 1)))
    own = users.select(F.col("id").alias("user_id"), "created_at").join(first, F.col("user_id") == F.col("_user"), "left")
    own = own.withColumn("_start", start).where(F.col("_start") <= last)
    calendar = own.select("user_id", F.explode(F.sequence("_start", last, F.expr("INTERVAL 1 DAY"))).alias("day"))
    out = calendar.join(counted, (F.col("user_id") == F.col("_user")) & (F.col("day") == F.col("_day")), "left")
    out = out.withColumn("used", F.coalesce(F.col("used"), F.lit(0)).cast("bigint"))
    return out.select("user_id", "day", "used", *quota(F.col("used"), limit))


def usage_on_day(audit: DataFrame, day: Column, exclude: str | None = None) -> DataFrame:
    """Per-user count for one day (the filter is a range on created_at, so it prunes)."""
    start = day_of(day)
    end = start + F.make_dt_interval(days=F.lit(1))
    calls = api_calls(audit, exclude).where((F.col("created_at") >= start) & (F.col("created_at") < end))
    return calls.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count(F.lit(1)).alias("used"))


def usage_by_key(keys: DataFrame, users: DataFrame, audit: DataFrame, day: Column,
                 limit: int = DAILY_LIMIT) -> DataFrame:
    """Today's usage per API key: key -> owner (must exist) -> count; no activity -> 0."""
    owners = keys.select(F.col("id").alias("key_id"), "key", "user_id").join(
        users.select(F.col("id").alias("user_id"), "email"), "user_id", "inner")
    counted = usage_on_day(audit, day)
    out = owners.join(counted, "user_id", "left").withColumn("used", F.coalesce(F.col("used"), F.lit(0)).cast("bigint"))
    return out.select("key_id", "key", "user_id", "email", "used", *quota(F.col("used"), limit))
