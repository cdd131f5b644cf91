"""Decision rules as Column expressions: ordered ladders become CASE WHEN chains.

Lookup tables here are tiny literal maps (tens of entries, fixed by the rule
set), so they are inlined with ``create_map`` + ``try_element_at`` — no join,
no shuffle, and they stay in codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, js_trim, shorten, utf16_length

# --- fixed values -----------------------------------------------------------
# Job-title filter: exact texts and partial patterns that mark UI text, not a title.
EXACT_UI_TEXTS = (
    "keywords & skills analyzer",
    "keywords and skills analyzer",
    "cover letter generator",
    "coverletter generator",
    "update to our terms",
    "ask about your fit",
    "ask about your experience",
    "ask about your fit or experience",
)
UI_PATTERNS = (
    "update terms",
    "keywords &",
    "& skills analyzer",
    "cover letter generator",
    "letter generator",
)
TITLE_MIN, TITLE_MAX = 3, 200

# Error code -> HTTP status.
ERROR_STATUS = {
    "INVALID_API_KEY": 401, "MISSING_API_KEY": 401, "AUTH_REQUIRED": 401, "AUTH_ERROR": 401,
    "FORBIDDEN": 403, "API_KEY_INACTIVE": 403, "USER_DELETED": 403, "USER_NOT_VERIFIED": 403,
    "DATA_ERROR": 500,
    "VALIDATION_ERROR": 400, "MISSING_FIELD": 400, "INVALID_FIELD": 400, "INVALID_FILE_TYPE": 400,
    "FILE_TOO_LARGE": 413, "INVALID_JSON": 400, "INVALID_FORMAT": 400,
    "NOT_FOUND": 404, "RESOURCE_NOT_FOUND": 404, "RECORD_NOT_FOUND": 404,
    "DUPLICATE_ENTRY": 409, "ALREADY_EXISTS": 409,
    "QUOTA_EXCEEDED": 429, "RATE_LIMIT_EXCEEDED": 429,
    "INTERNAL_SERVER_ERROR": 500, "DATABASE_ERROR": 500, "DATABASE_CONNECTION_ERROR": 503,
    "EXTERNAL_SERVICE_ERROR": 502, "SERVICE_UNAVAILABLE": 503, "CONFIGURATION_ERROR": 500,
    "AI_SERVICE_ERROR": 502, "AI_QUOTA_EXCEEDED": 429, "AI_INVALID_RESPONSE": 502, "AI_TIMEOUT": 504,
}
# Codes that page a developer even below status 500.
ATTENTION_CODES = ("DATABASE_ERROR", "DATABASE_CONNECTION_ERROR", "CONFIGURATION_ERROR",
                   "AI_SERVICE_ERROR", "SERVICE_UNAVAILABLE")
# Message fragments (lower-cased) and codes that make a model call retryable.
RETRYABLE_FRAGMENTS = ("503", "service unavailable", "overloaded", "try again later",
                       "temporarily unavailable")
RETRYABLE_CODES = ("503", "429")
# First path segment -> service name; anything else is upper-cased.
SERVICE_NAMES = {
    "chat": "CHAT", "coverletter": "COVER_LETTER", "experience": "EXPERIENCE",
    "keywords": "KEYWORDS", "upload-resume": "UPLOAD_RESUME", "hr-lookup": "HR_LOOKUP",
    "applied-jobs": "APPLIED_JOBS", "auth": "AUTH", "health": "HEALTH",
}
SLOW_MS = 1000
# Browser-extension origin prefixes.
EXTENSION_ORIGINS = (("chrome-extension://", "chrome_extension"),
                     ("moz-extension://", "firefox_extension"),
                     ("safari-extension://", "safari_extension"))
LOCALHOST_ORIGINS = ("http://localhost:", "https://localhost:")
# ---------------------------------------------------------------------------


def _literal_map(d: dict) -> Column:
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def _lit_re(text: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?()[]{}|\\" else ch for ch in text)


def _ui_text_regex() -> str:
    """One pattern over the lower-cased, trimmed title for every UI-text rule.

    Exact texts, pattern-at-start/end/inside-with-blanks, and the "contains
    both" rules (lookaheads, so overlapping words count like two contains()).
    """
    exact = "|".join(_lit_re(t) for t in EXACT_UI_TEXTS)
    pats = "|".join(_lit_re(p) for p in UI_PATTERNS)
    both = [("keyword",), ("analyzer",)], [("update",), ("terms", "our")], \
        [("cover letter", "coverletter"), ("generator",)]
    pairs = "|".join("".join("(?=.*(?:" + "|".join(_lit_re(w) for w in alt) + "))" for alt in rule) for rule in both)
    return rf"(?s)^(?:{exact})\z|^(?:{pats}) | (?:{pats})\z| (?:{pats}) |^(?:{pairs})"


TITLE_REJECT_RE = _ui_text_regex()


def is_job_title(title) -> Column:
    """True when ``title`` looks like a real job title (rules applied in source order).

    Written so the trimmed / lower-cased title is computed a fixed number of
    times per row: lengths, one letters test, one combined UI-text regex.
    (The source's "only digits, blanks, dashes, dots" rule can never fire after
    the three-letters rule, so it has no code.)
    """
    raw = _c(title)
    t = js_trim(raw)
    n = utf16_length(t)
    reject = ((raw == "") | (n < TITLE_MIN) | (n > TITLE_MAX) | ~raw.rlike("[a-zA-Z]{3}")
              | F.lower(t).rlike(TITLE_REJECT_RE))
    return F.when(raw.isNull(), F.lit(False)).otherwise(~F.coalesce(reject, F.lit(True)))


def is_slow(ms, limit: int = SLOW_MS) -> Column:
    return _c(ms) > limit


def needs_attention(status, code) -> Column:
    """Server error, or a code that needs a developer."""
    status, code = _c(status), _c(code)
    return F.coalesce(status >= 500, F.lit(False)) | F.coalesce(code.isin(*ATTENTION_CODES), F.lit(False))


def alert_gate(status, code) -> Column:
    """Outer gate before alerting: an error code is set, or status >= 500."""
    status, code = _c(status), _c(code)
    return F.coalesce((code.isNotNull() & (code != "")) | (status >= 500), F.lit(False))


def is_retryable(message, code=None, status=None) -> Column:
    msg = F.lower(F.coalesce(_c(message), F.lit("")))
    hit = F.lit(False)
    for frag in RETRYABLE_FRAGMENTS:
        hit = hit | msg.contains(frag)
    for extra in (code, status):
        if extra is not None:
            hit = hit | F.coalesce(_c(extra).cast("string").isin(*RETRYABLE_CODES), F.lit(False))
    return hit


def status_for_code(code, explicit_status=None) -> Column:
    """Explicit status first, then the code table, else 500."""
    mapped = F.try_element_at(_literal_map(ERROR_STATUS), _c(code))
    parts = ([_c(explicit_status)] if explicit_status is not None else []) + [mapped, F.lit(500)]
    return F.coalesce(*parts)


def _outcome(code: str, status: int) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(status).alias("status"))


def classify_error(name, code, message) -> Column:
    """Normalise a raw error into struct(code, status); first matching rule wins."""
    name, code, message = _c(name), _c(code), _c(message)
    db_request = (F.when(code == "P2002", _outcome("DUPLICATE_ENTRY", 409))
                  .when(code == "P2025", _outcome("NOT_FOUND", 404))
                  .when(code.isin("P2003", "P2014"), _outcome("VALIDATION_ERROR", 400))
                  .otherwise(_outcome("DATABASE_ERROR", 500)))
    code_set = code.isNotNull() & (code != "")
    msg_set = message.isNotNull() & (message != "")
    return (F.when(name == "PrismaClientKnownRequestError", db_request)
            .when(name.isin("PrismaClientInitializationError", "PrismaClientUnknownRequestError"),
                  _outcome("DATABASE_ERROR", 500))
            .when(code_set & (code.startswith("P1") | code.isin("ECONNREFUSED", "ETIMEDOUT", "ENOTFOUND")),
                  _outcome("DATABASE_ERROR", 500))
            .when((name == "SyntaxError") & F.coalesce(message, F.lit("")).contains("JSON"),
                  _outcome("VALIDATION_ERROR", 400))
            .when(name.isin("ValidationError", "ValidatorError"), _outcome("VALIDATION_ERROR", 400))
            .when(code == "LIMIT_FILE_SIZE", _outcome("FILE_TOO_LARGE", 413))
            .when(msg_set & (message.contains("Invalid API key") | (message == "API key is required")),
                  _outcome("AUTH_ERROR", 401))
            .otherwise(_outcome("INTERNAL_SERVER_ERROR", 500)))


def key_outcome(presented, key_found, owner_found, key_active, key_deleted, owner_deleted,
                owner_verified, emit_codes: bool = True) -> Column:
    """API-key check ladder -> struct(code, status).

    ``emit_codes=False`` reproduces the middleware form, whose 401/403 replies
    for missing, unknown and inactive keys carry no code.
    """
    presented = _c(presented)

    def code(c):
        return c if emit_codes else None

    def out(c, s):
        return F.struct(F.lit(c).cast("string").alias("code"), F.lit(s).alias("status"))

    return (F.when(presented.isNull() | (presented == ""), out(code("MISSING_API_KEY"), 401))
            .when(~_c(key_found), out(code("INVALID_API_KEY"), 401))
            .when(~_c(owner_found), out("DATA_ERROR", 500))
            .when(~F.coalesce(_c(key_active), F.lit(False)), out(code("API_KEY_INACTIVE"), 403))
            .when(F.coalesce(_c(key_deleted), F.lit(False)), out(code("API_KEY_INACTIVE"), 403))
            .when(F.coalesce(_c(owner_deleted), F.lit(False)), out("USER_DELETED", 403))
            .when(~F.coalesce(_c(owner_verified), F.lit(False)), out("USER_NOT_VERIFIED", 403))
            .otherwise(out("OK", 200)))


def service_name(path) -> Column:
    """Strip a leading ``/api`` (bare prefix), take the first non-empty segment, map it."""
    rest = F.regexp_replace(_c(path), "^/api", "")
    first = F.get(F.filter(F.split(rest, "/", -1), lambda s: s != ""), 0)
    return F.when(first.isNull(), F.lit("UNKNOWN")).otherwise(
        F.coalesce(F.try_element_at(_literal_map(SERVICE_NAMES), first), F.upper(first)))


def alert_text(service, code, message, status, user_email, user_id, path) -> Column:
    """Chat-webhook alert body for one audit row."""
    service, code, message, status = _c(service), _c(code), _c(message), _c(status)
    user_email, user_id, path = _c(user_email), _c(user_id), _c(path)

    def truthy(c):
        return c.isNotNull() & (c.cast("string") != "")

    svc = F.when(truthy(service), service).otherwise(F.lit("Unknown Service"))
    shown_code = F.when(truthy(code), code).otherwise(F.concat(F.lit("Error "), status.cast("string")))
    msg = F.when(truthy(message), message).otherwise(F.lit("An error occurred"))
    short = shorten(msg, 100, 97, "...")
    uid = user_id.cast("string")
    who = (F.when(truthy(user_email), user_email)
           .when(truthy(uid), F.concat(F.lit("User ID: "), F.substring(uid, 1, 12), F.lit("...")))
           .otherwise(F.lit("Not yet logged in")))
    where = F.when(truthy(path), path).otherwise(F.lit("Unknown endpoint"))
    return F.concat(
        F.lit("\U0001F6A8 *"), svc, F.lit(" Error*\n\n*What happened:* "), short,
        F.lit("\n*User:* "), who, F.lit("\n*Where:* "), where,
        F.lit("\n\n*Technical Details:* "), shown_code, F.lit(" (Status: "), status.cast("string"), F.lit(")"))


def origin_class(origin, production_origins: tuple[str, ...] = ()) -> Column:
    """Label a request Origin header. Production origins are deployment config."""
    o = _c(origin)
    expr = F.when(o.isNull() | (o == ""), F.lit("none"))
    for prefix, label in EXTENSION_ORIGINS:
        expr = expr.when(o.startswith(prefix), F.lit(label))
    expr = expr.when(o.startswith(LOCALHOST_ORIGINS[0]) | o.startswith(LOCALHOST_ORIGINS[1]), F.lit("localhost"))
    if production_origins:
        expr = expr.when(o.isin(*production_origins), F.lit("production"))
    return expr.otherwise(F.lit("other"))


def client_ip(direct, socket, forwarded) -> Column:
    """First truthy of: direct address, socket address, X-Forwarded-For header; else null."""
    def truthy(c):
        return F.nullif(_c(c), F.lit(""))
    return F.coalesce(truthy(direct), truthy(socket), truthy(forwarded))
