"""Scalar text rules as built-in Column expressions (no Python UDFs).

All functions take ``Column`` or a column name and return a ``Column``; they
stay inside whole-stage codegen. JavaScript string semantics that Spark's
built-ins do not share (trim of all Unicode blanks, ``split(/\\s+/)``,
``charAt(0).toUpperCase()``) are spelled out below (btrim over the JS blank set,
regexes over a Java/RE2-compatible blank class).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# JavaScript's \s class (also what String.prototype.trim strips): ASCII blanks,
# vertical tab, Unicode space separators (Zs), line/paragraph separators, BOM.
# Written so the same pattern runs in Java regex and in RE2 (DuckDB).
JS_SPACE_BODY = r"\s\x0B\p{Zs}\x{2028}\x{2029}\x{feff}"
JS_SPACE = f"[{JS_SPACE_BODY}]"
# The same set spelled out as characters (for btrim, which strips any of them).
JS_SPACE_CHARS = ("\t\n\x0b\x0c\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
                  + "\u2028\u2029\u202f\u205f\u3000\ufeff")
TRUNCATED_SUFFIX = "... [truncated]"
TOKENS_PER_WORD = 1.3
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c) -> Column:
    """String.prototype.trim: strip every Unicode blank, not only U+0020 (no regex)."""
    return F.btrim(_c(c), F.lit(JS_SPACE_CHARS))


def is_blank(c) -> Column:
    """JS falsy-or-whitespace test for strings: null, '' or only blanks."""
    c = _c(c)
    return c.isNull() | (js_trim(c) == "")


def falsy_to_null(c) -> Column:
    """``value || null`` for strings: '' becomes null."""
    return F.nullif(_c(c), F.lit(""))


def js_split_ws(c) -> Column:
    """``s.split(/\\s+/)``: keeps leading/trailing empty pieces like JS does."""
    return F.split(_c(c), f"{JS_SPACE}+", -1)


def normalize_skill(c) -> Column:
    """Lower-case, then delete everything outside [a-z0-9] (so C, C++, C# collide)."""
    return F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", "")


def split_name(c) -> Column:
    """Full name -> struct(first_name, last_name); last word is the last name."""
    t = js_trim(_c(c))
    parts = F.split(t, f"{JS_SPACE}+", -1)
    n = F.size(parts)
    blank = _c(c).isNull() | (t == "")
    first = (F.when(blank, F.lit(""))
             .when(n == 1, F.get(parts, 0))
             .otherwise(F.array_join(F.slice(parts, F.lit(1), n - 1), " ")))
    last = F.when(blank | (n == 1), F.lit("")).otherwise(F.get(parts, n - 1))
    return F.struct(first.alias("first_name"), last.alias("last_name"))


def upper_first(c) -> Column:
    """``s.charAt(0).toUpperCase() + s.slice(1)`` (rest left as is, unlike initcap)."""
    c = _c(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def search_string(company, kind, location=None) -> Column:
    """Web-search text for one (company, query kind); unknown kind -> null."""
    company, kind = _c(company), _c(kind)
    base = (F.when(kind == "linkedin", F.concat(F.lit("site:linkedin.com/company/ "), company))
            .when(kind == "website", F.concat(company, F.lit(" website")))
            .when(kind == "hr_linkedin", F.concat(
                F.lit('site:linkedin.com/in/ "HR Manager" OR "Human Resources" OR '
                      '"Talent Acquisition" "'), company, F.lit('"'))))
    if location is None:
        return base
    loc = _c(location)
    return F.when(loc.isNotNull() & (loc != ""), F.concat(base, F.lit(" "), loc)).otherwise(base)


def name_from_slug(url) -> Column:
    """Profile URL -> struct(first_name, last_name) from the ``/in/<a>-<b>`` slug.

    Mirrors the source rule exactly: the piece between the first and second
    ``in/`` is the slug (so ``/in/martin/`` yields ``mart``), cut at ``/``, split
    on ``-``; at least two parts are needed; only the first letter is upper-cased.
    """
    url = _c(url)
    after = F.get(F.split(url, "in/", -1), 1)
    slug = F.get(F.split(after, "/", -1), 0)
    parts = F.split(slug, "-", -1)
    ok = url.contains("linkedin.com/in/") & (F.size(parts) >= 2)
    first = F.when(ok, upper_first(F.get(parts, 0)))
    last = F.when(ok, upper_first(F.get(parts, 1)))
    return F.struct(first.alias("first_name"), last.alias("last_name"))


def error_title(code) -> Column:
    """``AI_SERVICE_ERROR`` -> ``Ai Service Error`` (first char kept, rest lower-cased)."""
    words = F.split(_c(code), "_", -1)
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.substring(w, 1, 1), F.lower(F.substr(w, F.lit(2))))),
        " ")


def utf16_length(c) -> Column:
    """Length in UTF-16 code units, as JavaScript counts: characters beyond U+FFFF are two."""
    return F.floor(F.octet_length(F.encode(_c(c), "UTF-16BE")) / 2).cast("int")


def utf16_prefix(c, n: int) -> Column:
    """The first ``n`` UTF-16 code units, without the first half of a character that is cut through."""
    units = F.substring(F.encode(_c(c), "UTF-16BE"), 1, 2 * n)
    last = F.hex(F.substring(units, 2 * n - 1, 1))  # of a full prefix; shorter texts have no such byte
    whole = F.when(last.between("D8", "DB"), F.substring(units, 1, 2 * n - 2)).otherwise(units)
    return F.decode(whole, "UTF-16BE")


def shorten(c, limit: int, keep: int | None = None, suffix: str = "...") -> Column:
    """If longer than ``limit`` UTF-16 units: the first ``keep`` of them + ``suffix``; else unchanged."""
    c = _c(c)
    keep = limit if keep is None else keep
    # no text has more units than bytes
    return (F.when(F.octet_length(c) <= limit, c)
            .when(utf16_length(c) > limit, F.concat(utf16_prefix(c, keep), F.lit(suffix))).otherwise(c))


def text_stats(c) -> Column:
    """struct(chars, words, kb, est_tokens) as the service logs them.

    words = pieces of ``split(/\\s+/)`` ('' counts 1; edge blanks count);
    est_tokens = ceil(words * 1.3) in double arithmetic, like JavaScript.
    """
    c = _c(c)
    chars = utf16_length(c).cast("bigint")
    words = F.size(js_split_ws(c)).cast("bigint")
    return F.struct(
        chars.alias("chars"),
        words.alias("words"),
        F.round(chars / F.lit(1024.0), 2).alias("kb"),
        F.ceil(words.cast("double") * F.lit(TOKENS_PER_WORD)).alias("est_tokens"),
    )


def csv_cell(c) -> Column:
    """CSV field: null -> ''; quote (doubling quotes) only if it holds '"', ',' or newline."""
    s = _c(c).cast("string")
    return (F.when(s.isNull(), F.lit(""))
            .when(s.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))
            .otherwise(s))


def duration_ms(start, end) -> "Column":
    """Milliseconds between two timestamps (end - start)."""
    return F.timestamp_diff("MILLISECOND", _c(start), _c(end))


def iso_text(ts) -> "Column":
    """ISO-8601 text with milliseconds and a Z suffix, as ``Date.toISOString()`` prints it."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
