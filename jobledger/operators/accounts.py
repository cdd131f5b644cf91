"""API keys and accounts: owner lookup, status ladder, last use, first active key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import key_outcome
from ..functions.text import js_trim


def _users(users: DataFrame) -> DataFrame:
    return users.select(F.col("id").alias("owner_id"), F.col("email"), F.col("full_name").alias("name"),
                        F.col("is_deleted").alias("owner_deleted"), F.col("verified").alias("owner_verified"))


def with_owner(keys: DataFrame, users: DataFrame) -> DataFrame:
    """Key -> owner, left outer: a key whose owner is missing keeps a null owner."""
    k = keys.select(F.col("id").alias("key_id"), "key", "user_id",
                    F.col("is_active").alias("key_active"), F.col("is_deleted").alias("key_deleted"))
    return k.join(_users(users), k.user_id == F.col("owner_id"), "left")


def key_status(keys: DataFrame, users: DataFrame, emit_codes: bool = True) -> DataFrame:
    """Outcome of presenting each stored key (ladder from 'no owner' down to OK)."""
    j = with_owner(keys, users)
    o = key_outcome(F.col("key"), F.lit(True), F.col("owner_id").isNotNull(), F.col("key_active"),
                    F.col("key_deleted"), F.col("owner_deleted"), F.col("owner_verified"), emit_codes)
    return j.select(F.col("key_id").alias("id"), "key", "user_id", "email", "name",
                    o["code"].alias("code"), o["status"].alias("status"))


def check_requests(requests: DataFrame, keys: DataFrame, users: DataFrame,
                   emit_codes: bool = True) -> DataFrame:
    """Outcome per request from its raw key header (trimmed like JS before lookup).

    Requests without a key or with a blank one name no stored key: they are answered where they
    are read, and only the others are joined.
    """
    req = requests.withColumn("lookup_key", js_trim(F.col("presented_key")))
    named = F.coalesce(F.col("lookup_key") != "", F.lit(False))
    owned = with_owner(keys, users)
    j = req.where(named).join(owned, F.col("lookup_key") == F.col("key"), "left").unionByName(
        req.where(~named), allowMissingColumns=True)
    o = key_outcome(F.col("presented_key"), F.col("key_id").isNotNull(), F.col("owner_id").isNotNull(),
                    F.col("key_active"), F.col("key_deleted"), F.col("owner_deleted"), F.col("owner_verified"),
                    emit_codes)
    return j.select("request_id", "key_id", "created_at", o["code"].alias("code"), o["status"].alias("status"))


def latest_per_key(requests: DataFrame) -> DataFrame:
    """The latest request of each presented key: a hot key is one row per task before the shuffle."""
    key = js_trim(F.col("presented_key"))
    return requests.where(key != "").groupBy(key.alias("presented_key")).agg(
        F.max("request_id").alias("request_id"), F.max("created_at").alias("created_at"))


def key_last_used(keys: DataFrame, checked: DataFrame) -> DataFrame:
    """Set last_used_at = max(time of a successful check) per key (kept if newer already)."""
    used = (checked.where(F.col("status") == 200).groupBy("key_id")
            .agg(F.max("created_at").alias("new_last_used")))
    base = keys if "last_used_at" in keys.columns else keys.withColumn(
        "last_used_at", F.lit(None).cast("timestamp_ntz"))
    out = base.join(used, base.id == used.key_id, "left")
    return out.select("id", "key", F.greatest("last_used_at", "new_last_used").alias("last_used_at"))


def first_active_key(keys: DataFrame, users: DataFrame) -> DataFrame:
    """The first active key (by id) with its owner, if any: a top-1, not a sort of everything."""
    first = keys.where(F.col("is_active")).orderBy("id").limit(1)
    j = first.join(users.select(F.col("id").alias("owner_id"), "email"), F.col("user_id") == F.col("owner_id"), "left")
    return j.select("id", "key", "user_id", "email")
