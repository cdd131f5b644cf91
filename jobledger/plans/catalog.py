"""Registered queries: the Spark form of each operator and its DuckDB oracle.

``QUERIES[name] = (spark_fn, oracle_sql or None)``; ``spark_fn(spark, sf_dir)``
returns a DataFrame over the whole driver tables. Column names are aliased
identically on both sides. Queries without an oracle are checked against a
brute-force model in ``tests/``.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.contracts import broken_paths
from ..functions.jsonx import sanitize_json
from ..functions.text import JS_SPACE, JS_SPACE_CHARS, name_from_slug, split_name, text_stats
from ..operators import accounts, audit, contacts, integrity, jobs, profiles, skills, textgen, usage
from ..session import ensure_checkpoint_dir
from ..sources.dictionary import read_skill_json, read_skill_lines
from ..sources.uploads import MAX_UPLOAD_BYTES, upload_gate, write_uploads
from ..sources.versioned import VersionedTable
from ..streaming import usage_upkeep
from .fixtures import Views, audit_log_from
from .oracle_views import with_views

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

AS_OF = "2025-01-01 00:00:00"  # "now" for rows that default to the current time


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def deco(fn):
        QUERIES[name] = (fn, with_views(sql, *views) if sql else None)
        return fn
    return deco


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


# --- SQL spellings of the shared rules (DuckDB) -------------------------------
WS = JS_SPACE


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_TRIM_CHARS_SQL = " || ".join(f"chr({ord(ch)})" for ch in JS_SPACE_CHARS)


def trim_sql(x: str) -> str:
    return f"trim({x}, {_TRIM_CHARS_SQL})"


def norm_sql(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


def title_ok_sql(x: str) -> str:
    t = trim_sql(x)
    lt = f"lower({t})"
    pats = " OR ".join(f"starts_with({lt}, {q(p + ' ')}) OR ends_with({lt}, {q(' ' + p)}) OR contains({lt}, {q(' ' + p + ' ')})"
                       for p in R.UI_PATTERNS)
    exact = ", ".join(q(s) for s in R.EXACT_UI_TEXTS)
    reject = (f"length({t}) < 3 OR length({t}) > 200 OR NOT regexp_matches({t}, '[a-zA-Z]{{3}}') "
              f"OR {lt} IN ({exact}) OR {pats} "
              f"OR (contains({lt}, 'keyword') AND contains({lt}, 'analyzer')) "
              f"OR (contains({lt}, 'update') AND (contains({lt}, 'terms') OR contains({lt}, 'our'))) "
              f"OR ((contains({lt}, 'cover letter') OR contains({lt}, 'coverletter')) AND contains({lt}, 'generator')) "
              f"OR regexp_matches({t}, '^[0-9\\s\\-\\.]+$')")
    return f"(CASE WHEN {x} IS NULL OR {x} = '' THEN false ELSE NOT coalesce({reject}, true) END)"


def reason_sql(title: str, url: str) -> str:
    return (f"(CASE WHEN {title} IS NULL OR {title} = '' OR {url} IS NULL OR {url} = '' THEN {q(jobs.REJECT_MISSING)} "
            f"WHEN NOT {title_ok_sql(title)} THEN {q(jobs.REJECT_TITLE)} END)")


def service_sql(path: str) -> str:
    seg = f"list_filter(string_split(regexp_replace({path}, '^/api', ''), '/'), lambda s: s <> '')[1]"
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in R.SERVICE_NAMES.items())
    return f"(CASE WHEN {seg} IS NULL THEN 'UNKNOWN' ELSE (CASE {seg} {cases} ELSE upper({seg}) END) END)"


def shorten_sql(x: str, limit: int, keep: int, suffix: str) -> str:
    return f"(CASE WHEN length({x}) > {limit} THEN substr({x}, 1, {keep}) || {q(suffix)} ELSE {x} END)"


def error_fields_sql(status: str, body: str) -> tuple[str, str]:
    def f(name):
        return f"nullif(CASE WHEN json_valid({body}) THEN json_extract_string({body}, '$.{name}') END, '')"
    code = f"(CASE WHEN {status} >= 400 THEN coalesce({f('errorCode')}, {f('error_code')}, 'HTTP_' || CAST({status} AS VARCHAR)) END)"
    picked = f"coalesce({f('message')}, {f('error')})"
    msg = f"(CASE WHEN {status} >= 400 THEN {shorten_sql(picked, 1000, 1000, '... [truncated]')} END)"
    return code, msg


def status_sql(code: str) -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in R.ERROR_STATUS.items())
    return f"(CASE {code} {cases} ELSE 500 END)"


def title_case_sql(code: str) -> str:
    return f"array_to_string(list_transform(string_split({code}, '_'), lambda w: substr(w, 1, 1) || lower(substr(w, 2))), ' ')"


def rhu_sql(num: str, den: str, scale: int) -> str:
    m = 10 ** scale
    return (f"(CASE WHEN ({den}) <> 0 THEN floor((CAST({num} AS DOUBLE) * {2 * m} + CAST({den} AS DOUBLE)) "
            f"/ (CAST({den} AS DOUBLE) * 2)) / {m}.0 END)")


def outcome_sql(presented: str, key_found: str, owner_found: str, active: str, kdel: str, udel: str,
                verified: str, emit_codes: bool = True) -> tuple[str, str]:
    silent = set() if emit_codes else {"MISSING_API_KEY", "INVALID_API_KEY", "API_KEY_INACTIVE"}
    ladder = [(f"{presented} IS NULL OR {presented} = ''", "MISSING_API_KEY", 401),
              (f"NOT ({key_found})", "INVALID_API_KEY", 401),
              (f"NOT ({owner_found})", "DATA_ERROR", 500),
              (f"NOT coalesce({active}, false)", "API_KEY_INACTIVE", 403),
              (f"coalesce({kdel}, false)", "API_KEY_INACTIVE", 403),
              (f"coalesce({udel}, false)", "USER_DELETED", 403),
              (f"NOT coalesce({verified}, false)", "USER_NOT_VERIFIED", 403)]
    code = "CASE " + " ".join(f"WHEN {c} THEN {'NULL' if k in silent else q(k)}" for c, k, _ in ladder) + " ELSE 'OK' END"
    status = "CASE " + " ".join(f"WHEN {c} THEN {s}" for c, _, s in ladder) + " ELSE 200 END"
    return code, status


# =============================================================================
# usage metering
# =============================================================================

_API = "deleted_at IS NULL AND path LIKE '/api/%'"


@query("usage_rolling", f"""
SELECT count(*) AS n FROM audit_log
WHERE created_at >= (SELECT max(created_at) FROM audit_log) - INTERVAL 20 DAY
  AND {_API} AND path NOT LIKE '%applied-jobs%'""", ("audit_log",))
def q_usage_rolling(spark, d):
    a = Views(spark, d).audit_log
    return usage.usage_rolling(a, as_of=a.select(F.max("created_at")).scalar())


def _daily_sql(extra=""):
    return f"""
SELECT user_id, CAST(CAST(created_at AS DATE) AS TIMESTAMP) AS day, count(*) AS used, 20 AS daily_limit,
       greatest(0, 20 - count(*)) AS remaining, count(*) >= 20 AS exceeded
FROM audit_log WHERE {_API} AND user_id IS NOT NULL {extra} GROUP BY 1, 2"""


@query("usage_daily", _daily_sql(), ("audit_log",))
def q_usage_daily(spark, d):
    return usage.usage_daily(Views(spark, d).audit_log)


@query("usage_daily_intent", _daily_sql("AND path NOT LIKE '%applied-jobs%'"), ("audit_log",))
def q_usage_daily_intent(spark, d):
    return usage.usage_daily(Views(spark, d).audit_log, exclude=usage.EXCLUDED_PATH)


@query("usage_by_key", f"""
WITH day AS (SELECT CAST(CAST(max(created_at) AS DATE) AS TIMESTAMP) AS d FROM audit_log),
cnt AS (SELECT a.user_id, count(*) AS used FROM audit_log a, day
        WHERE {_API} AND a.user_id IS NOT NULL AND a.created_at >= day.d AND a.created_at < day.d + INTERVAL 1 DAY
        GROUP BY a.user_id)
SELECT k.id AS key_id, k.key, k.user_id, u.email, coalesce(c.used, 0) AS used, 20 AS daily_limit,
       greatest(0, 20 - coalesce(c.used, 0)) AS remaining, coalesce(c.used, 0) >= 20 AS exceeded
FROM api_keys k JOIN users u ON k.user_id = u.id LEFT JOIN cnt c ON c.user_id = k.user_id""",
       ("audit_log", "api_keys", "users"))
def q_usage_by_key(spark, d):
    v = Views(spark, d)
    return usage.usage_by_key(v.api_keys, v.users, v.audit_log, v.audit_log.select(F.max("created_at")).scalar())


_UPKEEP_SQL = _daily_sql()


@query("usage_calendar", f"""
WITH cnt AS (SELECT user_id, CAST(CAST(created_at AS DATE) AS TIMESTAMP) AS day, count(*) AS used
             FROM audit_log WHERE {_API} AND user_id IS NOT NULL GROUP BY 1, 2),
last AS (SELECT CAST(CAST(max(created_at) AS DATE) AS TIMESTAMP) AS d FROM audit_log),
own AS (SELECT u.id AS user_id, d, least(CAST(CAST(u.created_at AS DATE) AS TIMESTAMP), min(cnt.day)) AS first
        FROM user_accounts u CROSS JOIN last LEFT JOIN cnt ON cnt.user_id = u.id GROUP BY u.id, u.created_at, d),
cal AS (SELECT user_id, unnest(generate_series(first, d, INTERVAL 1 DAY)) AS day FROM own WHERE first <= d)
SELECT cal.user_id, cal.day, coalesce(cnt.used, 0) AS used, 20 AS daily_limit,
       greatest(0, 20 - coalesce(cnt.used, 0)) AS remaining, coalesce(cnt.used, 0) >= 20 AS exceeded
FROM cal LEFT JOIN cnt ON cnt.user_id = cal.user_id AND cnt.day = cal.day""", ("audit_log", "user_accounts"))
def q_usage_calendar(spark, d):
    v = Views(spark, d)
    return usage.usage_calendar(v.audit_log, v.user_accounts, v.audit_log.select(F.max("created_at")).scalar())


@query("usage_daily_upkeep", _UPKEEP_SQL, ("audit_log",))
def q_usage_daily_upkeep(spark, d):
    """The events as a stream, in micro-batches of files; the sum of the batches' counts."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/usage-upkeep-{uuid.uuid4().hex}"
    # a pattern, as a streamed path that is none must be a folder
    events = spark.readStream.schema(Views(spark, d).raw("events").schema).parquet(f"{d.rstrip('/')}/events.parque[t]")
    usage_upkeep.start_usage_upkeep(audit_log_from(events), f"{base}/deltas", f"{base}/checkpoint",
                                    available_now=True).awaitTermination()
    return usage_upkeep.daily_totals(spark, f"{base}/deltas")


# =============================================================================
# accounts
# =============================================================================

_KS_CODE, _KS_STATUS = outcome_sql("k.key", "true", "u.id IS NOT NULL", "k.is_active", "k.is_deleted",
                                   "u.is_deleted", "u.verified")


@query("key_status", f"""
SELECT k.id, k.key, k.user_id, u.email, u.full_name AS name, {_KS_CODE} AS code, {_KS_STATUS} AS status
FROM api_keys k LEFT JOIN users u ON k.user_id = u.id""", ("api_keys", "users"))
def q_key_status(spark, d):
    v = Views(spark, d)
    return accounts.key_status(v.api_keys, v.users)


_KC_CODE, _KC_STATUS = outcome_sql("r.presented_key", "k.id IS NOT NULL", "u.id IS NOT NULL", "k.is_active",
                                   "k.is_deleted", "u.is_deleted", "u.verified")
_KEY_CHECK = f"""
SELECT r.request_id, k.id AS key_id, r.created_at, {_KC_CODE} AS code, {_KC_STATUS} AS status
FROM key_requests r LEFT JOIN api_keys k ON {trim_sql('r.presented_key')} = k.key
LEFT JOIN users u ON k.user_id = u.id"""


@query("key_check", _KEY_CHECK, ("key_requests", "api_keys", "users"))
def q_key_check(spark, d):
    v = Views(spark, d)
    return accounts.check_requests(v.key_requests, v.api_keys, v.users)


@query("key_last_used", f"""
WITH chk AS ({_KEY_CHECK}),
used AS (SELECT key_id, max(created_at) AS t FROM chk WHERE status = 200 GROUP BY key_id)
SELECT k.id, k.key, used.t AS last_used_at FROM api_keys k LEFT JOIN used ON used.key_id = k.id""",
       ("key_requests", "api_keys", "users"))
def q_key_last_used(spark, d):
    v = Views(spark, d)
    return accounts.key_last_used(v.api_keys, accounts.check_requests(
        accounts.latest_per_key(v.key_requests), v.api_keys, v.users))


@query("first_active_key", """
SELECT k.id, k.key, k.user_id, u.email
FROM (SELECT * FROM api_keys WHERE is_active ORDER BY id LIMIT 1) k LEFT JOIN users u ON k.user_id = u.id""",
       ("api_keys", "users"))
def q_first_active_key(spark, d):
    v = Views(spark, d)
    return accounts.first_active_key(v.api_keys, v.users)


# =============================================================================
# jobs
# =============================================================================

@query("title_filter", f"SELECT id, title, {title_ok_sql('title')} AS is_valid FROM applied_jobs", ("applied_jobs",))
def q_title_filter(spark, d):
    return Views(spark, d).applied_jobs.select("id", "title", R.is_job_title(F.col("title")).alias("is_valid"))


@query("required_fields", f"SELECT sub_id, {reason_sql('title', 'url')} AS reject_reason FROM job_submissions",
       ("job_submissions",))
def q_required_fields(spark, d):
    s = Views(spark, d).job_submissions
    return s.select("sub_id", jobs.reject_reason(F.col("title"), F.col("url")).alias("reject_reason"))


@query("job_normalize", f"""
SELECT sub_id, nullif(company, '') AS company, nullif(location, '') AS location,
       nullif(applied_text, '') AS applied_text, coalesce(applied_date, TIMESTAMP '{AS_OF}') AS applied_date,
       'Applied' AS status
FROM job_submissions""", ("job_submissions",))
def q_job_normalize(spark, d):
    s = jobs.normalize_job(Views(spark, d).job_submissions, _as_of())
    return s.select("sub_id", "company", "location", "applied_text", "applied_date", "status")


@query("schema_defaults", "SELECT sub_id, 'Applied' AS status, 'Website' AS type FROM job_submissions",
       ("job_submissions",))
def q_schema_defaults(spark, d):
    return jobs.fill_defaults(Views(spark, d).job_submissions).select("sub_id", "status", "type")


@query("jobs_dedup", """
SELECT user_id, url, id, title, status, applied_date FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, url ORDER BY applied_date ASC NULLS FIRST, id) AS rn
  FROM applied_jobs) WHERE rn = 1""", ("applied_jobs",))
def q_jobs_dedup(spark, d):
    return jobs.first_tracked(Views(spark, d).applied_jobs).select("user_id", "url", "id", "title", "status",
                                                                   "applied_date")


_VALID = f"SELECT * FROM job_submissions WHERE {reason_sql('title', 'url')} IS NULL"
# arrival order of submissions; sub_id alone repeats in the data, so the order is made total
ARRIVAL = ("sub_id", "applied_date", "title", "company", "location", "applied_text")
_ARRIVAL_SQL = ", ".join(f"{c} ASC NULLS FIRST" for c in ARRIVAL)


@query("jobs_new", f"""
WITH v AS ({_VALID})
SELECT sub_id, user_id, url FROM v
WHERE NOT EXISTS (SELECT 1 FROM applied_jobs j WHERE j.user_id = v.user_id AND j.url = v.url)""",
       ("job_submissions", "applied_jobs"))
def q_jobs_new(spark, d):
    v = Views(spark, d)
    valid, _ = jobs.split_valid(v.job_submissions)
    return jobs.split_tracked(valid, v.applied_jobs)[0].select("sub_id", "user_id", "url")


@query("jobs_existing", f"""
WITH v AS ({_VALID})
SELECT sub_id, user_id, url FROM v
WHERE EXISTS (SELECT 1 FROM applied_jobs j WHERE j.user_id = v.user_id AND j.url = v.url)""",
       ("job_submissions", "applied_jobs"))
def q_jobs_existing(spark, d):
    v = Views(spark, d)
    valid, _ = jobs.split_valid(v.job_submissions)
    return jobs.split_tracked(valid, v.applied_jobs)[1].select("sub_id", "user_id", "url")


_MERGE_COLS = ("id", "user_id", "title", "url", "status", "applied_date", "company", "location", "applied_text",
               "origin")


@query("jobs_merge", f"""
WITH v AS ({_VALID}),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, url ORDER BY {_ARRIVAL_SQL}) AS rn FROM v) WHERE rn = 1),
n AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM applied_jobs j WHERE j.user_id = f.user_id AND j.url = f.url))
SELECT id, user_id, title, url, status, applied_date, CAST(NULL AS VARCHAR) AS company,
       CAST(NULL AS VARCHAR) AS location, CAST(NULL AS VARCHAR) AS applied_text, 'existing' AS origin
FROM applied_jobs
UNION ALL
SELECT sub_id, user_id, title, url, 'Applied', coalesce(applied_date, TIMESTAMP '{AS_OF}'), nullif(company, ''),
       nullif(location, ''), nullif(applied_text, ''), 'new'
FROM n""", ("job_submissions", "applied_jobs"))
def q_jobs_merge(spark, d):
    v = Views(spark, d)
    table = jobs.merge_jobs(v.applied_jobs, v.job_submissions, _as_of(), order=ARRIVAL)[0]
    return table.select(*_MERGE_COLS)


@query("jobs_already_tracked", f"""
WITH v AS ({_VALID}),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, url ORDER BY {_ARRIVAL_SQL}) AS rn FROM v)
SELECT sub_id, user_id, url FROM r
WHERE rn > 1 OR EXISTS (SELECT 1 FROM applied_jobs j WHERE j.user_id = r.user_id AND j.url = r.url)""",
       ("job_submissions", "applied_jobs"))
def q_jobs_already_tracked(spark, d):
    v = Views(spark, d)
    return jobs.merge_jobs(v.applied_jobs, v.job_submissions, _as_of(), order=ARRIVAL)[3].select("sub_id", "user_id", "url")


_JOB_COLS = ("id", "user_id", "title", "url", "status", "applied_date")


@query("owned_changes", """
SELECT c.id, c.user_id, c.seq, c.status FROM job_changes c
WHERE EXISTS (SELECT 1 FROM applied_jobs j WHERE j.id = c.id AND j.user_id = c.user_id)""",
       ("job_changes", "applied_jobs"))
def q_owned_changes(spark, d):
    v = Views(spark, d)
    return jobs.split_owned(v.job_changes, v.applied_jobs)[0]


@query("unowned_changes", """
SELECT c.id, c.user_id, c.seq, c.status FROM job_changes c
WHERE NOT EXISTS (SELECT 1 FROM applied_jobs j WHERE j.id = c.id AND j.user_id = c.user_id)""",
       ("job_changes", "applied_jobs"))
def q_unowned_changes(spark, d):
    v = Views(spark, d)
    return jobs.split_owned(v.job_changes, v.applied_jobs)[1]


@query("jobs_delete", """
SELECT j.* FROM applied_jobs j
WHERE NOT EXISTS (SELECT 1 FROM job_changes c WHERE c.id = j.id AND c.user_id = j.user_id)""",
       ("job_changes", "applied_jobs"))
def q_jobs_delete(spark, d):
    v = Views(spark, d)
    return jobs.delete_jobs(v.applied_jobs, v.job_changes).select(*_JOB_COLS)


@query("jobs_status", """
SELECT j.id, j.user_id, j.title, j.url, coalesce(c.status, j.status) AS status, j.applied_date
FROM applied_jobs j LEFT JOIN (
  SELECT id, user_id, arg_max(status, seq) AS status FROM job_changes WHERE status IS NOT NULL AND status <> ''
  GROUP BY id, user_id) c ON c.id = j.id AND c.user_id = j.user_id""", ("job_changes", "applied_jobs"))
def q_jobs_status(spark, d):
    v = Views(spark, d)
    return jobs.set_status(v.applied_jobs, v.job_changes).select(*_JOB_COLS)


@query("jobs_by_user", "SELECT user_id, applied_date, id, title FROM applied_jobs", ("applied_jobs",))
def q_jobs_by_user(spark, d):
    return jobs.newest_first(Views(spark, d).applied_jobs).select("user_id", "applied_date", "id", "title")


_OWNER = 7


@query("jobs_of_owner", f"""
SELECT user_id, applied_date, id, title FROM applied_jobs WHERE user_id = {_OWNER}""", ("applied_jobs",))
def q_jobs_of_owner(spark, d):
    return jobs.newest_first(Views(spark, d).applied_jobs, _OWNER).select("user_id", "applied_date", "id", "title")


_VERSION_BUCKETS = 32


@query("jobs_versions", f"""
WITH v AS ({_VALID}),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, url ORDER BY {_ARRIVAL_SQL}) AS rn FROM v) WHERE rn = 1),
n AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM applied_jobs j WHERE j.user_id = f.user_id AND j.url = f.url)),
v0 AS (SELECT id, user_id, title, url, status, applied_date FROM applied_jobs),
v1 AS (SELECT * FROM v0 UNION ALL
       SELECT sub_id, user_id, title, url, 'Applied', coalesce(applied_date, TIMESTAMP '{AS_OF}') FROM n),
c AS (SELECT id, user_id, arg_max(status, seq) AS status FROM job_changes WHERE status IS NOT NULL AND status <> ''
      GROUP BY id, user_id),
v2 AS (SELECT v1.id, v1.user_id, title, url, coalesce(c.status, v1.status) AS status, applied_date
       FROM v1 LEFT JOIN c ON c.id = v1.id AND c.user_id = v1.user_id),
v3 AS (SELECT * FROM v2 WHERE NOT EXISTS (SELECT 1 FROM job_changes c WHERE c.id = v2.id AND c.user_id = v2.user_id))
SELECT 0 AS version, * FROM v0 UNION ALL SELECT 1, * FROM v1 UNION ALL SELECT 2, * FROM v2 UNION ALL SELECT 3, * FROM v3""",
       ("job_submissions", "applied_jobs", "job_changes"))
def q_jobs_versions(spark, d):
    """Insert, status and delete batches committed one after the other; every version read back."""
    v = Views(spark, d)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/jobs-{uuid.uuid4().hex}"
    stored = v.applied_jobs.select(*_JOB_COLS, *[F.lit(None).cast("string").alias(c) for c in ("company", "location", "applied_text")])
    table = VersionedTable.create(stored, path, ["user_id"], _VERSION_BUCKETS)
    table.apply(v.job_submissions, lambda rows, new: jobs.merge_jobs(rows, new, _as_of(), order=ARRIVAL)[0])
    table.apply(v.job_changes, jobs.set_status)
    table.apply(v.job_changes, jobs.delete_jobs)
    out = [table.read(n).select(F.lit(n).alias("version"), *_JOB_COLS) for n in table.versions()]
    return functools.reduce(DataFrame.unionByName, out)


# =============================================================================
# request log
# =============================================================================

_EC, _EM = error_fields_sql("status_code", "response_body")
_REC = f"""SELECT *, {service_sql('path')} AS service, response_ms > 1000 AS is_slow,
       {_EC} AS derived_code, {_EM} AS error_message FROM audit_log"""


@query("audit_enrich", f"""
WITH rec AS ({_REC})
SELECT id, user_id, path, service, status_code, is_slow, derived_code AS error_code, error_message FROM rec""",
       ("audit_log",))
def q_audit_enrich(spark, d):
    r = audit.audit_record(Views(spark, d).audit_log)
    return r.select("id", "user_id", "path", "service", "status_code", "is_slow", "error_code", "error_message")


@query("slow_requests", "SELECT id, path, response_ms FROM audit_log WHERE response_ms > 1000", ("audit_log",))
def q_slow_requests(spark, d):
    return audit.slow_requests(Views(spark, d).audit_log).select("id", "path", "response_ms")


_ATTN = ", ".join(q(c) for c in R.ATTENTION_CODES)
_ALERT_WHERE = (f"((derived_code IS NOT NULL AND derived_code <> '') OR status_code >= 500) "
                f"AND (status_code >= 500 OR derived_code IN ({_ATTN}))")


@query("alert_rows", f"""
WITH rec AS ({_REC})
SELECT id, status_code, derived_code AS error_code FROM rec WHERE {_ALERT_WHERE}""", ("audit_log",))
def q_alert_rows(spark, d):
    return audit.alert_rows(audit.audit_record(Views(spark, d).audit_log)).select("id", "status_code", "error_code")


_WHO = ("CASE WHEN u.email IS NOT NULL AND u.email <> '' THEN u.email "
        "WHEN r.user_id IS NOT NULL THEN 'User ID: ' || substr(CAST(r.user_id AS VARCHAR), 1, 12) || '...' "
        "ELSE 'Not yet logged in' END")
_MSG = "coalesce(nullif(r.error_message, ''), 'An error occurred')"
_ALERT_TEXT = (f"'\U0001F6A8 *' || coalesce(nullif(r.service, ''), 'Unknown Service') || ' Error*' || chr(10) || chr(10) "
               f"|| '*What happened:* ' || {shorten_sql(_MSG, 100, 97, '...')} || chr(10) "
               f"|| '*User:* ' || ({_WHO}) || chr(10) || '*Where:* ' || coalesce(nullif(r.path, ''), 'Unknown endpoint') "
               f"|| chr(10) || chr(10) || '*Technical Details:* ' "
               f"|| coalesce(nullif(r.derived_code, ''), 'Error ' || CAST(r.status_code AS VARCHAR)) "
               f"|| ' (Status: ' || CAST(r.status_code AS VARCHAR) || ')'")


@query("alert_messages", f"""
WITH rec AS ({_REC})
SELECT r.id, r.service, r.status_code, r.derived_code AS error_code, {_ALERT_TEXT} AS alert_text
FROM rec r LEFT JOIN users u ON r.user_id = u.id WHERE {_ALERT_WHERE.replace('derived_code', 'r.derived_code').replace('status_code', 'r.status_code')}""",
       ("audit_log", "users"))
def q_alert_messages(spark, d):
    v = Views(spark, d)
    return audit.alert_messages(audit.audit_record(v.audit_log), v.users)


@query("error_status", f"""
WITH rec AS ({_REC})
SELECT id, derived_code AS error_code, {status_sql('derived_code')} AS http_status,
       {title_case_sql('derived_code')} AS title
FROM rec WHERE derived_code IS NOT NULL""", ("audit_log",))
def q_error_status(spark, d):
    return audit.error_status(audit.audit_record(Views(spark, d).audit_log))


@query("origin_class", """
SELECT id, CASE WHEN origin IS NULL OR origin = '' THEN 'none'
  WHEN starts_with(origin, 'chrome-extension://') THEN 'chrome_extension'
  WHEN starts_with(origin, 'moz-extension://') THEN 'firefox_extension'
  WHEN starts_with(origin, 'safari-extension://') THEN 'safari_extension'
  WHEN starts_with(origin, 'http://localhost:') OR starts_with(origin, 'https://localhost:') THEN 'localhost'
  ELSE 'other' END AS origin_class FROM audit_log""", ("audit_log",))
def q_origin_class(spark, d):
    return audit.origins(Views(spark, d).audit_log)


_HEADERS = (("Content-Type", "'application/json'"), ("X-Api-Key", "'key_' || CAST(user_id AS VARCHAR)"),
            ("Authorization", "'Bearer t' || CAST(id AS VARCHAR)"), ("User-Agent", "'ext/1.0'"))


def _redact_sql(k: str) -> str:
    hit = " OR ".join(f"contains(lower({q(k)}), {q(s)})" for s in ("api-key", "authorization", "token"))
    return hit


@query("headers_sanitize", " UNION ALL ".join(
    f"SELECT id, {q(k)} AS header, CASE WHEN {_redact_sql(k)} THEN '[REDACTED]' ELSE {v} END AS value FROM audit_log"
    for k, v in _HEADERS), ("audit_log",))
def q_headers_sanitize(spark, d):
    from ..functions.jsonx import sanitize_headers
    a = Views(spark, d).audit_log
    h = F.create_map(F.lit("Content-Type"), F.lit("application/json"),
                     F.lit("X-Api-Key"), F.concat(F.lit("key_"), F.col("user_id").cast("string")),
                     F.lit("Authorization"), F.concat(F.lit("Bearer t"), F.col("id").cast("string")),
                     F.lit("User-Agent"), F.lit("ext/1.0"))
    return a.select("id", F.explode(sanitize_headers(h)).alias("header", "value"))


@query("request_summary", """
SELECT id, CASE json_type(request_body) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array'
  WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS body_kind,
  CAST(coalesce(len(json_keys(request_body)), 0) AS INT) AS n_keys,
  coalesce(array_to_string(json_keys(request_body), ','), '') AS keys
FROM audit_log""", ("audit_log",))
def q_request_summary(spark, d):
    from ..functions.jsonx import request_summary
    s = request_summary(F.col("request_body"))
    return Views(spark, d).audit_log.select("id", s["body_kind"].alias("body_kind"), s["n_keys"].alias("n_keys"),
                                            s["keys"].alias("keys"))


def doc_bodies(spark, d) -> DataFrame:
    """Request-like JSON bodies built from whole documents (nested, long strings, long arrays, all sizes of numbers)."""
    docs = Views(spark, d).raw("documents")
    n = F.col("n_chars").cast("double")
    body = F.to_json(F.struct(
        F.struct(F.col("doc_id").alias("id"),
                 F.struct("lang", "source", F.array("lang", "source").alias("tags")).alias("meta")).alias("doc"),
        F.col("source").alias("apiKey"),
        F.split(F.col("text"), "\n").alias("lines"),
        F.col("text"), F.col("n_chars"),
        (n * 1e18).alias("big"), (n / 1e9).alias("small"), (n / 8).alias("10"), (-n).alias("2")))
    return docs.select("doc_id", body.alias("body"))


def _body_sanitize_sql() -> str:
    """The sanitised ``doc_bodies`` written down field by field, numbers from the digits of the integer ``n_chars``."""
    mark = '"[Max Depth Reached]"'
    # characters beyond U+FFFF are two units: the longest prefix of at most 1000 of them
    units = "length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))"

    def cut(x):
        prefix = f"substr({x}, 1, 1000)"
        short = (f"substr({x}, 1, list_max(list_filter(range(500, 1001), lambda k: "
                 f"{units.format(f'substr({x}, 1, CAST(k AS INT))')} <= 1000)))")
        fits = f"{units.format(prefix)} <= 1000"
        return (f"CASE WHEN {units.format(x)} <= 1000 THEN {x} "
                f"ELSE (CASE WHEN {fits} THEN {prefix} ELSE {short} END) || '... [truncated]' END")

    def field(name, value, present):
        return f"CASE WHEN {present} IS NOT NULL THEN '\"{name}\":' || {value} END"
    d, n = "rtrim(CAST(n_chars AS VARCHAR), '0')", "length(CAST(n_chars AS VARCHAR))"
    point = f"substr({d}, 1, 1) || CASE WHEN length({d}) > 1 THEN '.' ELSE '' END || substr({d}, 2)"
    eighths = "rtrim(lpad(CAST(n_chars % 8 * 125 AS VARCHAR), 3, '0'), '0')"
    meta = ", ".join([field("lang", q(mark), "lang"), field("source", q(mark), "source"), field("tags", q(mark), "''")])
    doc = ", ".join([field("id", "doc_id", "doc_id"), f"'\"meta\":{{' || concat_ws(',', {meta}) || '}}'"])
    fields = [
        field("2", "CASE WHEN n_chars = 0 THEN '0' ELSE '-' || n_chars END", "n_chars"),
        field("10", f"(n_chars // 8) || CASE WHEN n_chars % 8 > 0 THEN '.' || {eighths} ELSE '' END", "n_chars"),
        f"'\"doc\":{{' || concat_ws(',', {doc}) || '}}'",
        field("apiKey", "'\"[REDACTED]\"'", "source"),
        field("lines", f"""'[' || array_to_string(list_transform(string_split(text, chr(10))[1:10],
          lambda x: CAST(to_json({cut('x')}) AS VARCHAR)), ',') || ']'""", "text"),
        field("text", f"CAST(to_json({cut('text')}) AS VARCHAR)", "text"),
        field("n_chars", "n_chars", "n_chars"),
        field("big", f"CASE WHEN n_chars = 0 THEN '0' WHEN n_chars < 1000 THEN n_chars || repeat('0', 18) "
                     f"ELSE {point} || 'e+' || ({n} + 17) END", "n_chars"),
        field("small", f"CASE WHEN n_chars = 0 THEN '0' WHEN n_chars < 1000 THEN {point} || 'e-' || (10 - {n}) "
                       f"ELSE '0.' || rtrim(lpad(CAST(n_chars AS VARCHAR), 9, '0'), '0') END", "n_chars")]
    return f"SELECT doc_id, '{{' || concat_ws(',', {', '.join(fields)}) || '}}' AS sanitized FROM documents"


@query("body_sanitize", _body_sanitize_sql())
def q_body_sanitize(spark, d):
    return doc_bodies(spark, d).select("doc_id", sanitize_json("body").alias("sanitized"))


# =============================================================================
# errors and integrity
# =============================================================================

@query("error_classify", """
WITH c AS (SELECT id, CASE
  WHEN name = 'PrismaClientKnownRequestError' THEN CASE WHEN code = 'P2002' THEN 'DUPLICATE_ENTRY'
       WHEN code = 'P2025' THEN 'NOT_FOUND' WHEN code IN ('P2003', 'P2014') THEN 'VALIDATION_ERROR' ELSE 'DATABASE_ERROR' END
  WHEN name IN ('PrismaClientInitializationError', 'PrismaClientUnknownRequestError') THEN 'DATABASE_ERROR'
  WHEN code IS NOT NULL AND code <> '' AND (starts_with(code, 'P1') OR code IN ('ECONNREFUSED', 'ETIMEDOUT', 'ENOTFOUND')) THEN 'DATABASE_ERROR'
  WHEN name = 'SyntaxError' AND contains(coalesce(message, ''), 'JSON') THEN 'VALIDATION_ERROR'
  WHEN name IN ('ValidationError', 'ValidatorError') THEN 'VALIDATION_ERROR'
  WHEN code = 'LIMIT_FILE_SIZE' THEN 'FILE_TOO_LARGE'
  WHEN message IS NOT NULL AND message <> '' AND (contains(message, 'Invalid API key') OR message = 'API key is required') THEN 'AUTH_ERROR'
  ELSE 'INTERNAL_SERVER_ERROR' END AS error_code FROM error_log)
SELECT id, error_code, CASE error_code WHEN 'DUPLICATE_ENTRY' THEN 409 WHEN 'NOT_FOUND' THEN 404
  WHEN 'VALIDATION_ERROR' THEN 400 WHEN 'FILE_TOO_LARGE' THEN 413 WHEN 'AUTH_ERROR' THEN 401 ELSE 500 END AS status,
  """ + title_case_sql("error_code") + """ AS title FROM c""", ("error_log",))
def q_error_classify(spark, d):
    from ..functions.text import error_title
    c = R.classify_error(F.col("name"), F.col("code"), F.col("message"))
    e = Views(spark, d).error_log.select("id", c["code"].alias("error_code"), c["status"].alias("status"))
    return e.withColumn("title", error_title(F.col("error_code")))


@query("retryable_errors", """
SELECT id, (contains(lower(coalesce(message, '')), '503') OR contains(lower(coalesce(message, '')), 'service unavailable')
  OR contains(lower(coalesce(message, '')), 'overloaded') OR contains(lower(coalesce(message, '')), 'try again later')
  OR contains(lower(coalesce(message, '')), 'temporarily unavailable') OR coalesce(code IN ('503', '429'), false)) AS retryable
FROM error_log""", ("error_log",))
def q_retryable_errors(spark, d):
    e = Views(spark, d).error_log
    return e.select("id", R.is_retryable(F.col("message"), F.col("code")).alias("retryable"))


@query("fk_orphans", """
SELECT 'api_keys' AS relation, k.id AS child_id, k.user_id AS fk FROM api_keys k
 WHERE k.user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM users u WHERE u.id = k.user_id)
UNION ALL
SELECT 'applied_jobs', j.id, j.user_id FROM applied_jobs j
 WHERE j.user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM users u WHERE u.id = j.user_id)
UNION ALL
SELECT 'job_submissions', s.sub_id, s.user_id FROM job_submissions s
 WHERE s.user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM users u WHERE u.id = s.user_id)""",
       ("api_keys", "applied_jobs", "job_submissions", "users"))
def q_fk_orphans(spark, d):
    v = Views(spark, d)
    parts = [("api_keys", v.api_keys, "id"), ("applied_jobs", v.applied_jobs, "id"),
             ("job_submissions", v.job_submissions, "sub_id")]
    out = None
    for rel, child, pk in parts:
        o = integrity.orphans(child, v.users, "user_id").select(
            F.lit(rel).alias("relation"), F.col(pk).alias("child_id"), F.col("user_id").alias("fk"))
        out = o if out is None else out.unionByName(o)
    return out


@query("cascade_delete", """
SELECT 'api_keys' AS relation, k.id FROM api_keys k
 WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.is_deleted AND u.id = k.user_id)
UNION ALL
SELECT 'applied_jobs', j.id FROM applied_jobs j
 WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.is_deleted AND u.id = j.user_id)""",
       ("api_keys", "applied_jobs", "users"))
def q_cascade_delete(spark, d):
    v = Views(spark, d)
    gone = v.users.where(F.col("is_deleted"))
    a = integrity.cascade(v.api_keys, gone, "user_id").select(F.lit("api_keys").alias("relation"), "id")
    b = integrity.cascade(v.applied_jobs, gone, "user_id").select(F.lit("applied_jobs").alias("relation"), "id")
    return a.unionByName(b)


@query("unique_violations", """
SELECT 'applied_jobs(user_id,url)' AS relation, CAST(user_id AS VARCHAR) || '|' || url AS key_value, count(*) AS n
 FROM applied_jobs GROUP BY user_id, url HAVING count(*) > 1
UNION ALL
SELECT 'users(email)', email, count(*) FROM users GROUP BY email HAVING count(*) > 1
UNION ALL
SELECT 'api_keys(key)', key, count(*) FROM api_keys GROUP BY key HAVING count(*) > 1""",
       ("applied_jobs", "users", "api_keys"))
def q_unique_violations(spark, d):
    v = Views(spark, d)
    a = integrity.violations(v.applied_jobs, ["user_id", "url"]).select(
        F.lit("applied_jobs(user_id,url)").alias("relation"),
        F.concat(F.col("user_id").cast("string"), F.lit("|"), F.col("url")).alias("key_value"), "n")
    b = integrity.violations(v.users, ["email"]).select(F.lit("users(email)").alias("relation"),
                                                        F.col("email").alias("key_value"), "n")
    c = integrity.violations(v.api_keys, ["key"]).select(F.lit("api_keys(key)").alias("relation"),
                                                         F.col("key").alias("key_value"), "n")
    return a.unionByName(b).unionByName(c)


_RELATION_VIEWS = ("mentors", "user_accounts", "api_keys", "applied_jobs", "progress", "user_status", "user_skills",
                   "resume_settings", "session_notes", "freetrial_users")
_VIEW_OF = {"users": "user_accounts"}
_ID_OF = {"user_skills": "user_id", "resume_settings": "user_id"}


def _relation_sql(r: integrity.Relation) -> str:
    child, parent = _VIEW_OF.get(r.child, r.child), _VIEW_OF.get(r.parent, r.parent)
    return (f"SELECT '{r.name}' AS relation, CAST(c.{_ID_OF.get(r.child, 'id')} AS VARCHAR) AS child_id, "
            f"CAST(c.{r.fk} AS VARCHAR) AS fk FROM {child} c WHERE c.{r.fk} IS NOT NULL "
            f"AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.id = c.{r.fk})")


@query("relations_broken", " UNION ALL ".join(map(_relation_sql, integrity.RELATIONS)), _RELATION_VIEWS)
def q_relations_broken(spark, d):
    return integrity.broken_relations(Views(spark, d).relations())


_LINKS_SQL = " UNION ALL ".join(
    f"SELECT '{r.child}' AS child, CAST({_ID_OF.get(r.child, 'id')} AS VARCHAR) AS child_id, '{r.parent}' AS parent, "
    f"CAST({r.fk} AS VARCHAR) AS parent_id FROM {_VIEW_OF.get(r.child, r.child)} WHERE {r.fk} IS NOT NULL"
    for r in integrity.RELATIONS if r.cascade)


@query("relations_cascade", f"""
WITH RECURSIVE links AS ({_LINKS_SQL}),
gone(table_name, id) AS (
  SELECT 'users', CAST(id AS VARCHAR) FROM user_accounts WHERE is_deleted
  UNION SELECT l.child, l.child_id FROM links l JOIN gone g ON l.parent = g.table_name AND l.parent_id = g.id)
SELECT table_name, id FROM gone""", _RELATION_VIEWS)
def q_relations_cascade(spark, d):
    tables = Views(spark, d).relations()
    return integrity.deleted_with(tables, {"users": tables["users"].where(F.col("is_deleted"))})


def _unique_sql(table: str, cols) -> str:
    keys = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    known = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    return (f"SELECT '{table}({','.join(cols)})' AS relation, {keys} AS key_value, count(*) AS n "
            f"FROM {_VIEW_OF.get(table, table)} WHERE {known} GROUP BY {', '.join(cols)} HAVING count(*) > 1")


@query("relations_unique", " UNION ALL ".join(_unique_sql(t, c) for t, c in integrity.UNIQUE), _RELATION_VIEWS)
def q_relations_unique(spark, d):
    return integrity.unique_violations(Views(spark, d).relations())


# =============================================================================
# skills
# =============================================================================

def _dict_sql(src: str, pos: str, name: str) -> str:
    return f"""SELECT norm, arg_max(name, pos) AS name FROM (
  SELECT pos, name, {norm_sql('name')} AS norm FROM (SELECT {pos} AS pos, {trim_sql(name)} AS name FROM {src})
  WHERE name <> '' AND NOT starts_with(name, '#')) GROUP BY norm"""


@query("skill_dictionary", _dict_sql("part", "p_partkey", "p_name"))
def q_skill_dictionary(spark, d):
    p = Views(spark, d).raw("part")
    return skills.build_dict(p, name_col="p_name", pos_col="p_partkey")


def _shared_folder(spark, label: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@query("skill_dictionary_file", _dict_sql("part", "p_partkey", "p_name"))
def q_skill_dictionary_file(spark, d):
    """The part names, written as a folder of line files in order of their key, and read as a dictionary."""
    path = _shared_folder(spark, "skill-lines")
    names = Views(spark, d).raw("part").repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey")
    names.select("p_name").write.text(path)
    return read_skill_lines(spark, path)


@query("skill_dictionary_json", f"""SELECT norm, arg_max(p_name, place) AS name FROM (
  SELECT p_name, p_brand || lpad(CAST(p_partkey AS VARCHAR), 20, '0') AS place, {norm_sql('p_name')} AS norm FROM part)
GROUP BY norm""")
def q_skill_dictionary_json(spark, d):
    """A document of brand and names per brand, read back in the order of their paths."""
    path = _shared_folder(spark, "skill-json")
    part = Views(spark, d).raw("part").groupBy("p_brand").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]).alias("names"))
    docs = part.select("p_brand", F.to_json(F.create_map("p_brand", "names")).alias("value"))
    docs.write.partitionBy("p_brand").text(path)
    return read_skill_json(spark, path)


@query("upload_gate", f"""
WITH f AS (SELECT page_id, octet_length(encode(CASE page_id % 3 WHEN 0 THEN '' ELSE '%PDF-' END || coalesce(html, ''))) + 1 AS n
  FROM pages),
g AS (SELECT page_id, CASE page_id % 500 WHEN 0 THEN greatest(n, {MAX_UPLOAD_BYTES} + 1)
  WHEN 250 THEN greatest(n, {MAX_UPLOAD_BYTES}) ELSE n END AS length FROM f)
SELECT page_id, CAST(length AS BIGINT) AS length, CASE WHEN length > {MAX_UPLOAD_BYTES} THEN 'FILE_TOO_LARGE'
  WHEN page_id % 3 = 0 OR page_id % 5 = 0 THEN 'INVALID_FILE_TYPE' END AS reject_code FROM g""")
def q_upload_gate(spark, d):
    """Every page as an uploaded file, read through the gate.

    Two thirds of the files begin with the PDF signature, four fifths are named .pdf; every 250th is filled up to the
    limit or a byte beyond it.
    """
    folder = _shared_folder(spark, "uploads")
    page = F.col("page_id")
    body = F.concat(F.when(page % 3 == 0, "").otherwise("%PDF-"), F.coalesce("html", F.lit("")))
    # the line end that closes a file is a byte of it too
    size = F.when(page % 500 == 0, MAX_UPLOAD_BYTES).when(page % 500 == 250, MAX_UPLOAD_BYTES - 1).otherwise(0)
    extension = F.when(page % 5 != 0, "pdf").otherwise("txt")
    write_uploads(Views(spark, d).raw("pages").select(page, extension.alias("extension"), body.alias("body"), size.alias("size")),
                  "page_id", folder)
    named = F.regexp_extract("path", r"/page_id=(-?\d+)[./]", 1).cast("long")
    # Spark plans a scan task per 32 small files, each with a result file of its own
    return upload_gate(spark, folder).select(named.alias("page_id"), "length", "reject_code").coalesce(256)


@query("skills_canonical", f"""
WITH dct AS ({_dict_sql('skill_dict', 'pos', 'name')}),
s AS (SELECT owner_id, pos, skill, {norm_sql('skill')} AS norm FROM skills_raw WHERE skill IS NOT NULL AND skill <> ''),
j AS (SELECT s.owner_id, s.pos, s.norm, coalesce(dct.name, {trim_sql('s.skill')}) AS skill FROM s LEFT JOIN dct ON s.norm = dct.norm)
SELECT owner_id, pos, skill FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, norm ORDER BY pos) AS rn FROM j)
WHERE rn = 1""", ("skills_raw", "skill_dict"))
def q_skills_canonical(spark, d):
    v = Views(spark, d)
    return skills.canonical(v.skills_raw, skills.build_dict(v.skill_dict))


@query("skills_flat", f"""
SELECT owner_id, skill, min(pos) AS pos FROM (
  SELECT owner_id, pos, {trim_sql('skill')} AS skill FROM skills_raw WHERE skill IS NOT NULL)
WHERE skill <> '' GROUP BY owner_id, skill""", ("skills_raw",))
def q_skills_flat(spark, d):
    return skills.flat_skills(Views(spark, d).skills_raw)


def _terms_sql(src: str, id_col: str, where: str = "") -> str:
    return f"""SELECT DISTINCT doc_id, term FROM (
  SELECT doc_id, {norm_sql('tok')} AS term FROM (
    SELECT {id_col} AS doc_id, unnest(string_split_regex(text, '{WS}+')) AS tok FROM {src} {where}))
  WHERE term <> ''"""


_REQ_HELD = f"""
WITH vocab AS (SELECT DISTINCT term FROM ({_terms_sql('benchmark', 'item_id')})),
req AS (SELECT * FROM ({_terms_sql('documents', 'doc_id')}) WHERE term IN (SELECT term FROM vocab)),
held AS ({_terms_sql('conversations', 'conv_id', "WHERE role = 'user'")})"""


def _required_held(spark, d):
    v = Views(spark, d)
    vocab = skills.terms(v.raw("benchmark"), "item_id", "text")
    required = skills.terms(v.raw("documents"), "doc_id", "text", vocabulary=vocab)
    held = skills.terms(v.raw("conversations").where(F.col("role") == "user"), "conv_id", "text")
    return required, held


@query("skills_present", _REQ_HELD + """
SELECT doc_id, term FROM req WHERE EXISTS (SELECT 1 FROM held h WHERE h.doc_id = req.doc_id AND h.term = req.term)""")
def q_skills_present(spark, d):
    return skills.present_missing(*_required_held(spark, d))[0]


@query("skills_missing", _REQ_HELD + """
SELECT doc_id, term FROM req WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.doc_id = req.doc_id AND h.term = req.term)""")
def q_skills_missing(spark, d):
    return skills.present_missing(*_required_held(spark, d))[1]


def _upsert_sql(full: bool) -> str:
    def pick(c):
        if full or c in ("skills", "updated_at"):
            return f"CASE WHEN n.user_id IS NOT NULL THEN n.{c} ELSE t.{c} END AS {c}"
        return f"t.{c} AS {c}"
    cols = ", ".join(pick(c) for c in ("skills", "skills_display_mode", "skills_line_time", "updated_at"))
    return f"""
WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, save_id DESC) AS rn
                FROM skill_saves WHERE skills IS NOT NULL) WHERE rn = 1)
SELECT coalesce(t.user_id, n.user_id) AS user_id, {cols}
FROM user_skills t FULL OUTER JOIN latest n ON t.user_id = n.user_id"""


def _upsert(spark, d, full):
    v = Views(spark, d)
    out = skills.upsert_skills(v.user_skills, v.skill_saves, full=full)
    return out.withColumn("skills", F.array_join("skills", "|"))


@query("skills_upsert", _upsert_sql(True), ("user_skills", "skill_saves"))
def q_skills_upsert(spark, d):
    return _upsert(spark, d, True)


@query("skills_upsert_partial", _upsert_sql(False), ("user_skills", "skill_saves"))
def q_skills_upsert_partial(spark, d):
    return _upsert(spark, d, False)


@query("skills_by_user", """
SELECT u.id AS user_id, coalesce(t.skills, '') AS skills, t.skills_display_mode, t.skills_line_time
FROM users u LEFT JOIN user_skills t ON t.user_id = u.id""", ("users", "user_skills"))
def q_skills_by_user(spark, d):
    v = Views(spark, d)
    return skills.skills_for(v.users, v.user_skills).withColumn("skills", F.array_join("skills", "|"))


# =============================================================================
# profiles
# =============================================================================

@query("profile_select", "SELECT id, full_name, email FROM users", ("users",))
def q_profile_select(spark, d):
    return profiles.profile(Views(spark, d).users)


_SPLIT = f"""
x AS (SELECT *, {trim_sql('full_name')} AS t FROM users),
y AS (SELECT *, string_split_regex(t, '{WS}+') AS parts FROM x),
nm AS (SELECT *, CASE WHEN full_name IS NULL OR t = '' THEN '' WHEN len(parts) = 1 THEN parts[1]
                      ELSE array_to_string(parts[1:len(parts) - 1], ' ') END AS first_name,
                 CASE WHEN full_name IS NULL OR t = '' OR len(parts) = 1 THEN '' ELSE parts[len(parts)] END AS last_name
       FROM y)"""


@query("split_name", f"WITH {_SPLIT}\nSELECT id, first_name, last_name FROM nm", ("users",))
def q_split_name(spark, d):
    s = split_name(F.col("full_name"))
    return Views(spark, d).users.select("id", s["first_name"].alias("first_name"), s["last_name"].alias("last_name"))


def _saved(k):
    return f"nullif(json_extract_string(s.personal_info, '$.{k}'), '')"


_SECTIONS = ", ".join(
    f"CASE WHEN s.user_id IS NOT NULL THEN CASE WHEN s.{c} IS NULL OR json_type(s.{c}) = 'NULL' "
    f"OR s.{c} IN ('false', '0', '\"\"') THEN '{default}' ELSE s.{c} END END AS {c}"
    for c, default in (("education", "[]"), ("experience", "[]"), ("skills", "[]"), ("projects", "[]"), ("custom_sections", "[]"),
                       ("skills_line_time", "[]"), ("section_order", "[]"), ("section_names", "{}")))


@query("resume_assemble", f"""
WITH {_SPLIT}
SELECT nm.id AS user_id, s.user_id IS NOT NULL AS has_resume, nm.first_name, nm.last_name,
  coalesce(nm.email, '') AS profile_email,
  CASE WHEN s.user_id IS NOT NULL THEN coalesce(nullif(nm.first_name, ''), {_saved('firstName')}, '') END AS info_first_name,
  CASE WHEN s.user_id IS NOT NULL THEN coalesce(nullif(nm.last_name, ''), {_saved('lastName')}, '') END AS info_last_name,
  CASE WHEN s.user_id IS NOT NULL THEN coalesce(nullif(coalesce(nm.email, ''), ''), {_saved('email')}, '') END AS info_email,
  json_extract_string(s.personal_info, '$.phone') AS info_phone,
  CASE WHEN s.user_id IS NOT NULL THEN CAST(len(list_filter(json_keys(s.personal_info),
       lambda k: k NOT IN ('firstName', 'lastName', 'email'))) + 3 AS INT) END AS n_info_keys,
  CASE WHEN s.user_id IS NOT NULL THEN coalesce(nullif(s.summary, ''), '') END AS professional_summary,
  CASE WHEN s.user_id IS NOT NULL THEN coalesce(nullif(s.display_mode, ''), 'twoColumnar') END AS skills_display_mode,
  {_SECTIONS},
  CASE WHEN s.user_id IS NOT NULL THEN CASE WHEN json_type(s.deleted_sections) = 'ARRAY' THEN s.deleted_sections ELSE '[]' END
  END AS deleted_sections,
  CASE WHEN s.user_id IS NOT NULL THEN {q(profiles.MSG_LOADED)} ELSE {q(profiles.MSG_NO_SETTINGS)} END AS message
FROM nm LEFT JOIN resume_settings s ON s.user_id = nm.id""", ("users", "resume_settings"))
def q_resume_assemble(spark, d):
    v = Views(spark, d)
    r = profiles.resume_assemble(v.users, v.resume_settings)
    info = F.col("personal_info")
    return r.select("user_id", "has_resume", "first_name", "last_name", "profile_email",
                    F.try_element_at(info, F.lit("firstName")).alias("info_first_name"),
                    F.try_element_at(info, F.lit("lastName")).alias("info_last_name"),
                    F.try_element_at(info, F.lit("email")).alias("info_email"),
                    F.try_element_at(info, F.lit("phone")).alias("info_phone"),
                    F.when(info.isNotNull(), F.size(info)).alias("n_info_keys"),
                    "professional_summary", "skills_display_mode", *profiles.SECTION_DEFAULTS, "deleted_sections", "message")


# =============================================================================
# contacts
# =============================================================================

_SEARCH_BASE = ("CASE kind WHEN 'linkedin' THEN 'site:linkedin.com/company/ ' || company "
                "WHEN 'website' THEN company || ' website' "
                "WHEN 'hr_linkedin' THEN 'site:linkedin.com/in/ \"HR Manager\" OR \"Human Resources\" OR "
                "\"Talent Acquisition\" \"' || company || '\"' END")


@query("search_strings", f"""
SELECT page_id, kind, ({_SEARCH_BASE}) || CASE WHEN location IS NOT NULL AND location <> '' THEN ' ' || location ELSE '' END AS query
FROM lookup_requests, (VALUES ('linkedin'), ('website'), ('hr_linkedin'), ('other')) AS k(kind)""",
       ("lookup_requests",))
def q_search_strings(spark, d):
    r = Views(spark, d).lookup_requests
    return contacts.search_requests(r, kinds=contacts.QUERY_KINDS + ("other",)).select("page_id", "kind", "query")


@query("company_clean", f"""
WITH c AS (SELECT page_id, list_filter(list_transform(companies_raw, lambda x: {trim_sql('x')}), lambda x: x IS NOT NULL AND x <> '') AS cs
           FROM lookup_requests)
SELECT page_id, CAST(len(cs) AS INT) AS n_companies, array_to_string(cs, '|') AS companies, len(cs) = 0 AS rejected,
       CASE WHEN len(cs) = 0 THEN {q(contacts.REJECT_NO_COMPANIES)} END AS reject_reason FROM c""",
       ("lookup_requests",))
def q_company_clean(spark, d):
    r = Views(spark, d).lookup_requests.select("page_id", contacts.clean_companies(F.col("companies_raw")).alias("cs"))
    none = F.size("cs") == 0
    return r.select("page_id", F.size("cs").alias("n_companies"), F.array_join("cs", "|").alias("companies"),
                    none.alias("rejected"), F.when(none, F.lit(contacts.REJECT_NO_COMPANIES)).alias("reject_reason"))


_LINKS = """SELECT company, kind, rank, hit_id, link, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY company, kind ORDER BY rank, hit_id) AS rn
  FROM search_hits WHERE link IS NOT NULL AND link <> '')
WHERE rn <= CASE kind WHEN 'hr_linkedin' THEN 3 ELSE 1 END"""


@query("contact_links", _LINKS, ("search_hits",))
def q_contact_links(spark, d):
    links = contacts.contact_links(Views(spark, d).search_hits)
    return links.select("company", "kind", "rank", "hit_id", "link", F.col("rn").cast("bigint").alias("rn"))


def _slug_sql(x: str) -> tuple[str, str]:
    parts = f"string_split(string_split(string_split({x}, 'in/')[2], '/')[1], '-')"
    ok = f"(contains({x}, 'linkedin.com/in/') AND len({parts}) >= 2)"

    def cap(p):
        return f"upper(substr({p}, 1, 1)) || substr({p}, 2)"
    return (f"CASE WHEN {ok} THEN {cap(parts + '[1]')} END", f"CASE WHEN {ok} THEN {cap(parts + '[2]')} END")


_FN, _LN = _slug_sql("w.hr_linkedin_url")
_WIDE = f"""
WITH l AS ({_LINKS}),
a AS (SELECT company,
        max(CASE WHEN kind = 'website' AND rn = 1 THEN link END) AS website,
        max(CASE WHEN kind = 'linkedin' AND rn = 1 THEN link END) AS company_linkedin_url,
        max(CASE WHEN kind = 'hr_linkedin' AND rn = 1 THEN link END) AS hr_linkedin_url,
        string_agg(CASE WHEN kind = 'hr_linkedin' THEN link END, '; ' ORDER BY rn) AS hr_links
      FROM l GROUP BY company),
w AS (SELECT c.company, a.website, a.company_linkedin_url, a.hr_linkedin_url, coalesce(a.hr_links, '') AS hr_links
      FROM (SELECT DISTINCT company FROM search_hits) c LEFT JOIN a ON a.company = c.company),
wide AS (SELECT w.*, {_FN} AS hr_first_name, {_LN} AS hr_last_name FROM w)"""


@query("contacts_wide", _WIDE + "\nSELECT * FROM wide", ("search_hits",))
def q_contacts_wide(spark, d):
    h = Views(spark, d).search_hits
    w = contacts.contacts_wide(contacts.contact_links(h), h)
    return w.withColumn("hr_links", F.array_join("hr_links", "; "))


def _cell_sql(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL THEN '' WHEN regexp_matches({x}, '[\",\\n]') "
            f"THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END)")


@query("contacts_csv", _WIDE + "\nSELECT company, " + " || ',' || ".join(
    _cell_sql(c) for c in ("company", "website", "company_linkedin_url", "hr_linkedin_url", "hr_links",
                           "hr_first_name", "hr_last_name")) + " AS csv_line FROM wide", ("search_hits",))
def q_contacts_csv(spark, d):
    h = Views(spark, d).search_hits
    w = contacts.contacts_wide(contacts.contact_links(h), h)
    return w.select("company", contacts.csv_line(w).alias("csv_line"))


_SFN, _SLN = _slug_sql("link")


@query("slug_names", f"SELECT hit_id, {_SFN} AS first_name, {_SLN} AS last_name FROM search_hits", ("search_hits",))
def q_slug_names(spark, d):
    n = name_from_slug(F.col("link"))
    return Views(spark, d).search_hits.select("hit_id", n["first_name"].alias("first_name"),
                                              n["last_name"].alias("last_name"))


# =============================================================================
# text-generation batches
# =============================================================================

@query("text_stats", f"""
SELECT doc_id, length(text) AS chars, len(string_split_regex(text, '{WS}+')) AS words,
       round(length(text) / 1024.0, 2) AS kb,
       CAST(ceil(len(string_split_regex(text, '{WS}+')) * CAST(1.3 AS DOUBLE)) AS BIGINT) AS est_tokens
FROM documents""")
def q_text_stats(spark, d):
    s = text_stats(F.col("text"))
    return Views(spark, d).raw("documents").select("doc_id", *[s[c].alias(c) for c in ("chars", "words", "kb",
                                                                                         "est_tokens")])


def _kw_prompt_sql() -> str:
    from ..functions import prompt_texts as P
    head = q(P.KEYWORDS_SYSTEM + "\n Job Description:\n")
    tail = q("\n\nResponse Format:" + P.KEYWORDS_SCHEMA)
    p = f"{head} || d.text || {q(chr(10) + chr(10) + 'Current Skills:' + chr(10))} || l.skills_json || {tail}"
    ok = "d.text IS NOT NULL AND d.text <> '' AND l.skills_json IS NOT NULL"
    return f"""
WITH l AS (SELECT owner_id, CAST(to_json(list(skill ORDER BY pos)) AS VARCHAR) AS skills_json FROM skills_raw GROUP BY owner_id),
pr AS (SELECT d.doc_id, CASE WHEN {ok} THEN 'ok' ELSE 'rejected' END AS status,
              CASE WHEN {ok} THEN NULL ELSE {q(textgen.REQUIRED_MESSAGES['keywords'])} END AS reject_reason,
              CASE WHEN {ok} THEN {p} END AS prompt
       FROM documents d LEFT JOIN l ON l.owner_id = d.doc_id)
SELECT doc_id, status, reject_reason, prompt, length(prompt) AS chars, len(string_split_regex(prompt, '{WS}+')) AS words,
       CAST(ceil(len(string_split_regex(prompt, '{WS}+')) * CAST(1.3 AS DOUBLE)) AS BIGINT) AS est_tokens
FROM pr"""


@query("prompt_build", _kw_prompt_sql(), ("skills_raw",))
def q_prompt_build(spark, d):
    v = Views(spark, d)
    return textgen.keyword_prompts(v.raw("documents"), v.skills_raw)


@query("call_metrics", f"""
SELECT id, service,
  CASE WHEN in_tokens IS NOT NULL AND out_tokens IS NOT NULL AND in_tokens + out_tokens > 0
       THEN {rhu_sql('in_tokens * 100', 'in_tokens + out_tokens', 1)} END AS input_share_pct,
  CASE WHEN total_tokens > 0 AND ms > 0 THEN {rhu_sql('total_tokens * 1000', 'ms', 2)} END AS tokens_per_sec,
  CASE WHEN in_tokens IS NOT NULL AND ms > 0 THEN {rhu_sql('in_tokens * 1000', 'ms', 2)} END AS in_tokens_per_sec,
  CASE WHEN out_tokens IS NOT NULL AND ms > 0 THEN {rhu_sql('out_tokens * 1000', 'ms', 2)} END AS out_tokens_per_sec
FROM llm_calls""", ("llm_calls",))
def q_call_metrics(spark, d):
    return textgen.call_metrics(Views(spark, d).llm_calls)


_TOKEN_AGG = """SELECT service, count(*) AS calls,
  count(CASE WHEN in_tokens IS NOT NULL AND out_tokens IS NOT NULL THEN 1 END) AS known_calls,
  CAST(sum(CASE WHEN in_tokens IS NOT NULL AND out_tokens IS NOT NULL THEN in_tokens END) AS BIGINT) AS in_tokens,
  CAST(sum(CASE WHEN in_tokens IS NOT NULL AND out_tokens IS NOT NULL THEN out_tokens END) AS BIGINT) AS out_tokens,
  CAST(sum(CASE WHEN in_tokens IS NOT NULL AND out_tokens IS NOT NULL THEN ms END) AS BIGINT) AS known_ms,
  CAST(sum(ms) AS BIGINT) AS total_ms, CAST(sum(CASE WHEN total_tokens > 0 THEN total_tokens END) AS BIGINT) AS total_tokens,
  CAST(sum(CASE WHEN total_tokens > 0 THEN ms END) AS BIGINT) AS reported_ms
FROM llm_calls GROUP BY service"""


@query("token_metrics", f"""
WITH g AS ({_TOKEN_AGG})
SELECT * EXCLUDE (reported_ms), CASE WHEN in_tokens + out_tokens > 0 THEN {rhu_sql('in_tokens * 100', 'in_tokens + out_tokens', 1)} END AS input_share_pct,
  CASE WHEN reported_ms > 0 THEN {rhu_sql('total_tokens * 1000', 'reported_ms', 2)} END AS tokens_per_sec
FROM g""", ("llm_calls",))
def q_token_metrics(spark, d):
    return textgen.token_metrics(Views(spark, d).llm_calls)


@query("stage_share", f"""
WITH g AS ({_TOKEN_AGG}), t AS (SELECT service, total_ms, sum(total_ms) OVER () AS total FROM g)
SELECT service, total_ms, CAST(total AS BIGINT) AS total, {rhu_sql('total_ms * 100', 'total', 1)} AS share_pct FROM t""",
       ("llm_calls",))
def q_stage_share(spark, d):
    return textgen.stage_share(textgen.token_metrics(Views(spark, d).llm_calls), "total_ms", "service")


def _extract_sql(lenient: bool) -> str:
    from ..functions.jsonx import FENCED_JSON, GREEDY_OBJECT
    fence = q(FENCED_JSON)
    greedy = q(GREEDY_OBJECT)
    g_ok = f"(coalesce(regexp_matches(t, {greedy}), false) AND coalesce(json_valid(regexp_extract(t, {greedy}, 0)), false))"
    status = ("CASE WHEN has_block AND block_ok THEN 'ok' WHEN has_block THEN 'bad_block' WHEN whole_ok THEN 'ok' "
              + (f"WHEN {g_ok} THEN 'ok' " if lenient else "") + "ELSE 'no_json' END")
    payload = ("CASE WHEN has_block AND block_ok THEN block WHEN NOT has_block AND whole_ok THEN t "
               + (f"WHEN NOT has_block AND NOT whole_ok AND {g_ok} THEN regexp_extract(t, {greedy}, 0) " if lenient else "")
               + "END")
    return f"""
WITH x AS (SELECT id, response_text AS t, coalesce(regexp_matches(response_text, {fence}), false) AS has_block,
                  regexp_extract(response_text, {fence}, 1) AS block FROM llm_calls),
y AS (SELECT *, coalesce(json_valid(block), false) AS block_ok, coalesce(json_valid(t), false) AS whole_ok FROM x)
SELECT id, {status} AS status, {payload} AS payload FROM y"""


@query("extract_json_strict", _extract_sql(False), ("llm_calls",))
def q_extract_json_strict(spark, d):
    return textgen.parse_replies(Views(spark, d).llm_calls, lenient=False)


@query("extract_json_lenient", _extract_sql(True), ("llm_calls",))
def q_extract_json_lenient(spark, d):
    return textgen.parse_replies(Views(spark, d).llm_calls, lenient=True)


def _shape_sql() -> str:
    from ..functions.jsonx import RESULT_SHAPES
    cols = []
    for kind, checks in RESULT_SHAPES.items():
        conds = " AND ".join(f"coalesce(json_type(payload, '{p}') = '{c}', false)" for p, c in checks)
        cols.append(f"CASE WHEN payload IS NULL THEN false ELSE {conds} END AS {kind}_ok")
    return f"WITH r AS ({_extract_sql(True)})\nSELECT id, " + ", ".join(cols) + " FROM r"


@query("reply_shapes", _shape_sql(), ("llm_calls",))
def q_reply_shapes(spark, d):
    return textgen.reply_shapes(textgen.parse_replies(Views(spark, d).llm_calls, lenient=True))


_ENTRY_FIELDS = (("company", "VARCHAR"), ("position", "VARCHAR"), ("description", "ARRAY"), ("description[]", "VARCHAR"))
_CONTRACTS_SQL = [
    ("keywords", "$", "OBJECT"), ("keywords", "$.present_skills", "ARRAY"), ("keywords", "$.present_skills[]", "VARCHAR"),
    ("keywords", "$.missing_skills", "ARRAY"), ("keywords", "$.missing_skills[]", "VARCHAR"),
    ("experience", "$", "OBJECT"), ("experience", "$.enhanced_experience", "ARRAY"), ("experience", "$.enhanced_experience[]", "OBJECT"),
    *(("experience", f"$.enhanced_experience[].{f}", t) for f, t in _ENTRY_FIELDS),
    ("resume", "$", "OBJECT"), ("resume", "$.formatted_resume", "OBJECT"), ("resume", "$.formatted_resume.name", "VARCHAR"),
    ("resume", "$.formatted_resume.position", "VARCHAR"), ("resume", "$.formatted_resume.experience", "ARRAY"),
    ("resume", "$.formatted_resume.experience[]", "OBJECT"),
    *(("resume", f"$.formatted_resume.experience[].{f}", t) for f, t in _ENTRY_FIELDS),
    ("resume", "$.formatted_resume.skills", "ARRAY"), ("resume", "$.formatted_resume.skills[]", "VARCHAR"),
    ("coverletter", "$", "OBJECT"), ("coverletter", "$.cover_letter", "OBJECT"),
    *(("coverletter", f"$.cover_letter.{f}", "VARCHAR")
      for f in ("to", "from", "subject", "greeting", "body", "closing", "regards", "name")),
]


@query("reply_violations", f"""
WITH c(kind, pat, type) AS (VALUES {", ".join(f"('{k}', '{p}', '{t}')" for k, p, t in _CONTRACTS_SQL)}),
nodes AS (SELECT r.id, r.kind, t.fullkey, regexp_replace(t.fullkey, '\\[\\d+\\]', '[]', 'g') AS pat, t.type
          FROM model_replies r, json_tree(CASE WHEN json_valid(r.payload) THEN r.payload ELSE '0' END) t
          WHERE json_valid(r.payload)),
bad AS (
  SELECT id, kind, '$: missing' AS v FROM model_replies WHERE NOT json_valid(payload)
  UNION ALL
  SELECT n.id, n.kind, n.fullkey || CASE c.type WHEN 'OBJECT' THEN ': not an object' WHEN 'ARRAY' THEN ': not an array'
         ELSE ': not a string' END FROM nodes n JOIN c ON c.kind = n.kind AND c.pat = n.pat WHERE n.type <> c.type
  UNION ALL
  SELECT n.id, n.kind, n.fullkey || '.' || regexp_extract(f.pat, '[^.]+$') || ': missing'
  FROM nodes n JOIN c ON c.kind = n.kind AND c.pat = n.pat AND c.type = 'OBJECT' AND n.type = 'OBJECT'
  JOIN c f ON f.kind = n.kind AND regexp_matches(f.pat, '[^\\]]$') AND f.pat <> '$' AND regexp_replace(f.pat, '\\.[^.]+$', '') = c.pat
  WHERE NOT EXISTS (SELECT 1 FROM nodes m WHERE m.id = n.id AND m.fullkey = n.fullkey || '.' || regexp_extract(f.pat, '[^.]+$')))
SELECT r.id, r.kind, CAST(count(v) AS INT) AS n_broken, coalesce(string_agg(v, ', ' ORDER BY v), '') AS broken
FROM model_replies r LEFT JOIN bad ON bad.id = r.id GROUP BY r.id, r.kind""", ("model_replies",))
def q_reply_violations(spark, d):
    r = Views(spark, d).model_replies.withColumn("b", broken_paths(F.col("payload"), F.col("kind")))
    return r.select("id", "kind", F.size("b").alias("n_broken"), F.array_join("b", ", ").alias("broken"))


# =============================================================================
# catalogue, truncations, client address
# =============================================================================

def _catalogue_entries(spark, d):
    """A model-catalogue-shaped view over ``part`` (ours): name, capability list, limits."""
    p = Views(spark, d).raw("part")
    name = F.lower(F.concat(F.col("p_type"), F.lit("-"), F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))))
    return p.select(name.alias("name"), F.col("p_brand").alias("display_name"),
                    F.when(F.col("p_size") % 5 == 0, F.lit("")).otherwise(F.col("p_name")).alias("description"),
                    F.when(F.col("p_size") % 4 == 0, F.lit(None).cast("int")).otherwise(F.col("p_size")).alias("input_limit"),
                    F.lit(None).cast("int").alias("output_limit"),
                    F.split(F.col("p_name"), " ").alias("capabilities"), F.col("p_partkey"))


_CAT_SQL = """SELECT lower(p_type || '-' || replace(p_name, ' ', '-')) AS name, p_brand AS display_name,
  CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END AS description,
  CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size END AS input_limit, CAST(NULL AS INT) AS output_limit,
  string_split(p_name, ' ') AS capabilities, p_partkey FROM part"""


@query("catalogue_filter", f"""
WITH c AS ({_CAT_SQL})
SELECT name, coalesce(nullif(display_name, ''), 'N/A') AS display_name, coalesce(nullif(description, ''), 'N/A') AS description,
  coalesce(CAST(input_limit AS VARCHAR), 'N/A') AS input_limit, coalesce(CAST(output_limit AS VARCHAR), 'N/A') AS output_limit,
  array_to_string(capabilities, ', ') AS methods
FROM c WHERE contains(name, 'economy') AND list_contains(capabilities, 'widget') ORDER BY name""")
def q_catalogue_filter(spark, d):
    from ..operators.catalogue import catalogue
    return catalogue(_catalogue_entries(spark, d), "economy", "widget")


@query("catalogue_preferred", f"""
WITH c AS ({_CAT_SQL})
SELECT p_partkey, name FROM c WHERE contains(name, 'small') AND (contains(name, 'red') OR contains(name, 'blue')
  OR contains(name, 'gear'))""")
def q_catalogue_preferred(spark, d):
    from ..operators.catalogue import preferred
    return preferred(_catalogue_entries(spark, d), "small", ("red", "blue", "gear")).select("p_partkey", "name")


@query("truncations", f"""
SELECT doc_id,
  {shorten_sql('text', 1000, 1000, '... [truncated]')} AS body_cut,
  substr(text, 1, 500) AS raw_cut,
  {shorten_sql('text', 100, 97, '...')} AS short_message,
  substr(source, 1, 8) || '...' AS key_hint,
  substr(text, 1, 50) || '...' AS agent_hint,
  substr(text, 1, 50) || CASE WHEN length(text) > 50 THEN '...' ELSE '' END AS title_hint,
  substr(CAST(doc_id AS VARCHAR), 1, 12) || '...' AS id_hint
FROM documents""")
def q_truncations(spark, d):
    from ..functions.text import TRUNCATED_SUFFIX, shorten
    t = F.col("text")
    return Views(spark, d).raw("documents").select(
        "doc_id",
        shorten(t, 1000, 1000, TRUNCATED_SUFFIX).alias("body_cut"),
        F.substring(t, 1, 500).alias("raw_cut"),
        shorten(t, 100, 97, "...").alias("short_message"),
        F.concat(F.substring("source", 1, 8), F.lit("...")).alias("key_hint"),
        F.concat(F.substring(t, 1, 50), F.lit("...")).alias("agent_hint"),
        F.concat(F.substring(t, 1, 50), F.when(F.length(t) > 50, F.lit("...")).otherwise(F.lit(""))).alias("title_hint"),
        F.concat(F.substring(F.col("doc_id").cast("string"), 1, 12), F.lit("...")).alias("id_hint"))


@query("client_ips", """
SELECT id, coalesce(nullif(CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE '10.0.0.' || CAST(id % 250 AS VARCHAR) END, ''),
                    nullif(CASE WHEN id % 8 < 4 THEN '::1' END, ''),
                    nullif('203.0.113.' || CAST(id % 200 AS VARCHAR), '')) AS client_ip
FROM audit_log""", ("audit_log",))
def q_client_ips(spark, d):
    a = Views(spark, d).audit_log
    direct = (F.when(F.col("id") % 4 == 0, F.lit(None).cast("string")).when(F.col("id") % 4 == 1, F.lit(""))
              .otherwise(F.concat(F.lit("10.0.0."), (F.col("id") % 250).cast("string"))))
    sock = F.when(F.col("id") % 8 < 4, F.lit("::1"))
    fwd = F.concat(F.lit("203.0.113."), (F.col("id") % 200).cast("string"))
    return a.select("id", R.client_ip(direct, sock, fwd).alias("client_ip"))


# --- more prompt kinds -----------------------------------------------------------

def _prompt_stats_sql(p: str, ok: str, reason: str) -> str:
    return (f"CASE WHEN {ok} THEN 'ok' ELSE 'rejected' END AS status, "
            f"CASE WHEN {ok} THEN NULL ELSE {reason} END AS reject_reason, CASE WHEN {ok} THEN {p} END AS prompt, "
            f"CASE WHEN {ok} THEN length({p}) END AS chars, "
            f"CASE WHEN {ok} THEN len(string_split_regex({p}, '{WS}+')) END AS words, "
            f"CASE WHEN {ok} THEN CAST(ceil(len(string_split_regex({p}, '{WS}+')) * CAST(1.3 AS DOUBLE)) AS BIGINT) END "
            f"AS est_tokens")


def _truthy_sql(*cols: str) -> str:
    return "(" + " AND ".join(f"{c} IS NOT NULL AND {c} <> ''" for c in cols) + ")"


def _chat_inputs(spark, d):
    """User turns are questions; the posting is the document with the conversation's id; the
    resume is the user's profile text (a string, kept as is)."""
    v = Views(spark, d)
    q_ = v.raw("conversations").where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    docs = v.raw("documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("job_description"))
    res = v.users.select(F.col("id").alias("conv_id"), F.col("full_name").alias("resume"))
    return q_.join(docs, "conv_id", "left").join(res, "conv_id", "left")


@query("prompt_chat", None)
def q_prompt_chat(spark, d):
    r = _chat_inputs(spark, d)
    cols = {k: F.col(k) for k in ("question", "job_description", "resume")}
    return textgen.build_prompts(r, "chat", ["conv_id", "turn"], cols, cols)


def _chat_sql() -> str:
    from ..functions import prompt_texts as P
    p = (f"{q(P.CHAT_SYSTEM + chr(10) + chr(10) + 'Job Description:' + chr(10))} || d.text || "
         f"{q(chr(10) + chr(10) + 'Candidate Resume (JSON):' + chr(10))} || u.full_name || "
         f"{q(chr(10) + chr(10) + 'User Question:' + chr(10))} || c.text")
    ok = _truthy_sql("c.text", "d.text", "u.full_name")
    return f"""
SELECT c.conv_id, c.turn, {_prompt_stats_sql(p, ok, q(textgen.REQUIRED_MESSAGES['chat']))}
FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id LEFT JOIN users u ON u.id = c.conv_id
WHERE c.role = 'user'"""


QUERIES["prompt_chat"] = (q_prompt_chat, with_views(_chat_sql(), "users"))


def _resume_json(c_email, c_name, c_seg) -> F.Column:
    return F.to_json(F.struct(c_name.alias("name"), c_email.alias("email"), c_seg.alias("segment")))


@query("prompt_cover_letter", None)
def q_prompt_cover_letter(spark, d):
    v = Views(spark, d)
    docs = v.raw("documents").select("doc_id", F.col("text").alias("job_description"))
    cust = v.raw("customer").select(F.col("c_custkey").alias("doc_id"), "c_name", "c_mktsegment")
    users = v.users.select(F.col("id").alias("doc_id"), "email")
    r = docs.join(cust, "doc_id", "left").join(users, "doc_id", "left")
    resume = F.when(F.col("c_name").isNotNull(), _resume_json(F.col("email"), F.col("c_name"), F.col("c_mktsegment")))
    r = r.withColumn("resume_json", resume)
    req = {"job_description": F.col("job_description"), "resume_json": F.col("resume_json")}
    return textgen.build_prompts(r, "coverletter", ["doc_id"], req, req)


def _cover_sql() -> str:
    from ..functions import prompt_texts as P
    rj = ("CASE WHEN c.c_name IS NOT NULL THEN '{\"name\":' || to_json(c.c_name) || ',\"email\":' || to_json(u.email) "
          "|| ',\"segment\":' || to_json(c.c_mktsegment) || '}' END")
    p = (f"{q(P.COVERLETTER_SYSTEM + chr(10) + ' Job Description:' + chr(10))} || d.text || "
         f"{q(chr(10) + chr(10) + 'resume:' + chr(10))} || ({rj}) || {q(chr(10) + chr(10) + 'Response Format:' + P.COVERLETTER_SCHEMA)}")
    ok = f"(d.text IS NOT NULL AND d.text <> '' AND ({rj}) IS NOT NULL)"
    return f"""
SELECT d.doc_id, {_prompt_stats_sql(p, ok, q(textgen.REQUIRED_MESSAGES['coverletter']))}
FROM documents d LEFT JOIN customer c ON c.c_custkey = d.doc_id LEFT JOIN users u ON u.id = d.doc_id"""


QUERIES["prompt_cover_letter"] = (q_prompt_cover_letter, with_views(_cover_sql(), "users"))


@query("prompt_resume_parse", None)
def q_prompt_resume_parse(spark, d):
    from ..functions.text import js_trim
    docs = Views(spark, d).raw("documents").select("doc_id", F.col("text").alias("resume_text"))
    req = {"resume_text": js_trim(F.col("resume_text"))}
    return textgen.build_prompts(docs, "upload_resume", ["doc_id"], req, {"resume_text": F.col("resume_text")},
                                 missing_first=F.col("resume_text").isNull())


def _resume_parse_sql() -> str:
    from ..functions import prompt_texts as P
    p = (f"{q(P.RESUME_SYSTEM + chr(10) + ' Candidate resume: ')} || text || "
         f"{q(chr(10) + ' Experience Schema: ' + P.EXPERIENCE_SCHEMA + ' and arrange all information in this format Resume Schema: ' + P.RESUME_SCHEMA)}")
    ok = f"(text IS NOT NULL AND {trim_sql('text')} <> '')"
    reason = f"CASE WHEN text IS NULL THEN {q(textgen.NO_RESUME_MESSAGE)} ELSE {q(textgen.REQUIRED_MESSAGES['upload_resume'])} END"
    return f"SELECT doc_id, {_prompt_stats_sql(p, ok, reason)} FROM documents"


QUERIES["prompt_resume_parse"] = (q_prompt_resume_parse, _resume_parse_sql())


@query("prompt_experience", None)
def q_prompt_experience(spark, d):
    """Experience rewrite prompts: the posting plus the candidate's experience list, built
    from the candidate's own customer row (one entry per candidate, no grouping)."""
    v = Views(spark, d)
    docs = v.raw("documents").select("doc_id", F.col("text").alias("job_description"))
    cust = v.raw("customer").select(
        F.col("c_custkey").alias("doc_id"),
        F.to_json(F.array(F.struct(F.col("c_name").alias("company"), F.col("c_mktsegment").alias("position"),
                                   F.array("c_mktsegment", "c_name").alias("description")))).alias("experience_json"))
    r = docs.join(cust, "doc_id", "left")
    req = {"job_description": F.col("job_description"), "experience_json": F.col("experience_json")}
    return textgen.build_prompts(r, "experience", ["doc_id"], req, req)


def _experience_sql() -> str:
    from ..functions import prompt_texts as P
    ej = ("CASE WHEN c.c_custkey IS NOT NULL THEN '[{\"company\":' || to_json(c.c_name) || ',\"position\":' "
          "|| to_json(c.c_mktsegment) || ',\"description\":[' || to_json(c.c_mktsegment) || ',' || to_json(c.c_name) "
          "|| ']}]' END")
    p = (f"{q(P.EXPERIENCE_SYSTEM + chr(10) + ' Job Description:' + chr(10))} || d.text || "
         f"{q(chr(10) + ' Experience:' + chr(10))} || ({ej}) || {q(chr(10) + 'Response Format:' + P.EXPERIENCE_SCHEMA)}")
    ok = f"(d.text IS NOT NULL AND d.text <> '' AND ({ej}) IS NOT NULL)"
    return f"""
SELECT d.doc_id, {_prompt_stats_sql(p, ok, q(textgen.REQUIRED_MESSAGES['experience']))}
FROM documents d LEFT JOIN customer c ON c.c_custkey = d.doc_id"""


QUERIES["prompt_experience"] = (q_prompt_experience, _experience_sql())


@query("jobs_replay", f"""
WITH s1 AS (
  SELECT j.id, j.user_id, j.title, j.url, coalesce(c.status, j.status) AS status, j.applied_date
  FROM applied_jobs j LEFT JOIN (
    SELECT id, user_id, arg_max(status, seq) AS status FROM job_changes WHERE status IS NOT NULL AND status <> ''
    GROUP BY id, user_id) c ON c.id = j.id AND c.user_id = j.user_id),
s2 AS (SELECT * FROM s1 WHERE NOT EXISTS (
  SELECT 1 FROM job_changes c WHERE c.status = 'Rejected' AND c.id = s1.id AND c.user_id = s1.user_id)),
v AS ({_VALID}),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, url ORDER BY {_ARRIVAL_SQL}) AS rn FROM v) WHERE rn = 1),
n AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM s2 WHERE s2.user_id = f.user_id AND s2.url = f.url))
SELECT id, user_id, title, url, status, applied_date FROM s2
UNION ALL
SELECT sub_id, user_id, title, url, 'Applied', coalesce(applied_date, TIMESTAMP '{AS_OF}') FROM n""",
       ("job_changes", "applied_jobs", "job_submissions"))
def q_jobs_replay(spark, d):
    """Status changes, then deletes (changes to 'Rejected'), then new submissions, with a
    checkpoint after the second step."""
    v = Views(spark, d)
    steps = [("status", v.job_changes), ("delete", v.job_changes.where(F.col("status") == "Rejected")),
             ("insert", v.job_submissions)]
    t = jobs.replay_changes(v.applied_jobs, steps, checkpoint_every=2, as_of=_as_of(), order=ARRIVAL)
    return t.select(*_JOB_COLS)


@query("status_change_outcomes", f"""
SELECT c.id, c.user_id, c.status,
  CASE WHEN c.status IS NULL OR c.status = '' THEN {q(jobs.REJECT_NO_STATUS)}
       WHEN NOT EXISTS (SELECT 1 FROM applied_jobs j WHERE j.id = c.id AND j.user_id = c.user_id)
       THEN {q(jobs.REJECT_NOT_FOUND)} END AS reject_reason
FROM job_changes c""", ("job_changes", "applied_jobs"))
def q_status_change_outcomes(spark, d):
    v = Views(spark, d)
    return jobs.change_outcomes(v.job_changes, v.applied_jobs, "status").select("id", "user_id", "status",
                                                                               "reject_reason")


_KM_CODE, _KM_STATUS = outcome_sql("r.presented_key", "k.id IS NOT NULL", "u.id IS NOT NULL", "k.is_active",
                                   "k.is_deleted", "u.is_deleted", "u.verified", emit_codes=False)


@query("key_check_middleware", f"""
SELECT r.request_id, k.id AS key_id, r.created_at, {_KM_CODE} AS code, {_KM_STATUS} AS status
FROM key_requests r LEFT JOIN api_keys k ON {trim_sql('r.presented_key')} = k.key
LEFT JOIN users u ON k.user_id = u.id""", ("key_requests", "api_keys", "users"))
def q_key_check_middleware(spark, d):
    """The middleware's form of the ladder: no code on missing, unknown or inactive keys."""
    v = Views(spark, d)
    return accounts.check_requests(v.key_requests, v.api_keys, v.users, emit_codes=False)
