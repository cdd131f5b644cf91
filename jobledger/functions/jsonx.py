"""JSON rules as built-in Column expressions.

The body sanitiser works at a fixed depth (3), so it is unrolled into nested
higher-order expressions at plan-build time instead of a Python UDF:

* ``from_json(x, 'map<string,string>')`` keeps key order and hands back the raw
  text of nested values (strings come back decoded);
* ``from_json(x, 'map<string,variant>')`` + ``schema_of_variant`` tells a string
  ``"1"`` from a number ``1``;
* the output is rebuilt as compact JSON text with ``concat``/``array_join``.

``parse_json`` -> ``to_json`` is *not* used for output because variant objects
sort their keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import json_semantics
from .text import JS_SPACE, JS_SPACE_CHARS, TRUNCATED_SUFFIX, _c, shorten, utf16_prefix

# --- fixed values -----------------------------------------------------------
MAX_DEPTH = 3
MAX_STRING = 1000
MAX_ARRAY = 10
MAX_KEYS = 50
MAX_RAW_RESPONSE = 500
MAX_INDEX_KEY = 4294967295  # JavaScript orders smaller whole-number keys before all others
DEPTH_MARK = "[Max Depth Reached]"
REDACTED = "[REDACTED]"
TOO_MANY_KEYS_KEY = "..."
TOO_MANY_KEYS = "[Too many keys, truncated]"
# Body keys are redacted when the lower-cased key contains one of these as is
# (so "apiKey" never matches, while "key" catches "monkey" and "keywords").
SENSITIVE_BODY_KEYS = ("password", "token", "apiKey", "api_key", "authorization", "x-api-key",
                       "secret", "key")
SENSITIVE_HEADER_KEYS = ("api-key", "authorization", "token")
# Fenced block: ```json <payload> ``` (first one wins, lazy payload).
FENCED_JSON = "```json" + JS_SPACE + r"*([\s\S]*?)" + JS_SPACE + "*```"
GREEDY_OBJECT = r"\{[\s\S]*\}"
# ---------------------------------------------------------------------------


def json_quote(s) -> Column:
    """JSON string literal for ``s`` (null -> ``null``)."""
    wrapped = F.to_json(F.array(_c(s)))
    return F.substr(wrapped, F.lit(2), F.length(wrapped) - 2)


def is_valid_json(c) -> Column:
    """Strict JSON validity of the whole text (nothing may follow the value).

    Of duplicate object keys the last wins, as ``session.json_semantics`` sets the parser.
    """
    c = _c(c)
    alone = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))  # text behind the value spoils the array
    return (F.try_parse_json(c).isNotNull() & alone.isNotNull()
            & F.try_variant_get(alone, "$[1]", "variant").isNull())


def json_kind(c) -> Column:
    """object / array / string / number / boolean / null, or null when not JSON."""
    t = F.schema_of_variant(F.try_parse_json(_c(c)))
    return (F.when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array")
            .when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t == "VOID", "null")
            .when(t.isNotNull(), "number"))


# --- fenced / lenient extraction --------------------------------------------

def _extract_steps(lenient: bool):
    """The extraction as ordered (name, expression) steps; later steps use earlier names."""
    t = F.col("_text")
    steps = [("_has_block", F.coalesce(t.rlike(FENCED_JSON), F.lit(False))),
             ("_block", F.regexp_extract(t, FENCED_JSON, 1))]
    steps += [("_block_ok", F.col("_has_block") & is_valid_json(F.col("_block"))),
              ("_whole_ok", ~F.col("_has_block") & is_valid_json(t))]
    if lenient:
        steps += [("_greedy", F.when(~F.col("_has_block") & ~F.col("_whole_ok"),
                                     F.regexp_extract(t, GREEDY_OBJECT, 0)))]
        steps += [("_greedy_ok", F.coalesce(F.col("_greedy") != "", F.lit(False)) & is_valid_json(F.col("_greedy")))]
    status = (F.when(F.col("_block_ok"), "ok").when(F.col("_has_block"), "bad_block")
              .when(F.col("_whole_ok"), "ok"))
    payload = F.when(F.col("_block_ok"), F.col("_block")).when(F.col("_whole_ok"), t)
    if lenient:
        status = status.when(F.col("_greedy_ok"), "ok")
        payload = payload.when(F.col("_greedy_ok"), F.col("_greedy"))
    return steps, status.otherwise("no_json"), payload


def extract_json_columns(df: DataFrame, text_col: str, lenient: bool = False,
                         status_col: str = "status", payload_col: str = "payload") -> DataFrame:
    """Status and payload of a model reply, as staged projections: every regex / parse runs once per row.

    status: ``ok`` | ``bad_block`` (a fenced block that is not JSON; never falls through) |
    ``no_json``. payload is the JSON text that parsed. ``lenient`` adds the greedy
    first-``{``-to-last-``}`` fallback.
    """
    json_semantics(df.sparkSession)
    steps, status, payload = _extract_steps(lenient)
    out = df.withColumn("_text", F.col(text_col))
    for name, expr in steps:
        out = out.withColumn(name, expr)
    out = out.withColumn(status_col, status).withColumn(payload_col, payload)
    return out.drop("_text", *[n for n, _ in steps])


# --- error fields from a response body --------------------------------------

ERROR_BODY_SCHEMA = "errorCode string, error_code string, message string, error string"


def with_error_fields(df: DataFrame, status_col: str, body_col: str,
                      code_col: str = "error_code", message_col: str = "error_message") -> DataFrame:
    """Error code and message of responses with status >= 400, as staged projections.

    code = errorCode or error_code or ``HTTP_<status>``; message = message or error (empty counts
    as absent), cut at 1000 characters. Only a body that is JSON as a whole has fields; bodies of
    other statuses are not parsed.
    """
    json_semantics(df.sparkSession)
    status = F.col(status_col)
    err = F.coalesce(status >= 400, F.lit(False))
    out = df.withColumn("_err", F.from_json(
        F.when(err & is_valid_json(F.col(body_col)), F.col(body_col)), ERROR_BODY_SCHEMA, {"allowSingleQuotes": "false"}))

    def field(name):
        return F.nullif(F.col(f"_err.{name}"), F.lit(""))
    code = F.coalesce(field("errorCode"), field("error_code"), F.concat(F.lit("HTTP_"), status.cast("string")))
    msg = shorten(F.coalesce(field("message"), field("error")), MAX_STRING, MAX_STRING, TRUNCATED_SUFFIX)
    return out.withColumn(code_col, F.when(err, code)).withColumn(message_col, F.when(err, msg)).drop("_err")


# --- header redaction --------------------------------------------------------

def sanitize_headers(headers) -> Column:
    """map<string,string> with sensitive header values replaced."""
    def redact(k, v):
        low = F.lower(k)
        hit = F.lit(False)
        for s in SENSITIVE_HEADER_KEYS:
            hit = hit | low.contains(s)
        return F.when(hit, F.lit(REDACTED)).otherwise(v)
    return F.transform_values(_c(headers), redact)


# --- body sanitiser (depth 3, unrolled) --------------------------------------
#
# The expression is generated as Spark SQL text and parsed once (one JVM call
# instead of thousands of Column-builder calls); the rule itself is the same
# nested transform / CASE structure either way.

def _sql_lit(text: str) -> str:
    """Spark SQL string literal (backslash escapes, non-ASCII as \\uXXXX)."""
    out = []
    for ch in text:
        if ch in "\\'":
            out.append("\\" + ch)
        elif ord(ch) < 0x20 or ord(ch) > 0x7E:
            out.append("\\u%04x" % ord(ch))
        else:
            out.append(ch)
    return "'" + "".join(out) + "'"


def _json_text(value: str) -> str:
    """SQL literal holding the JSON string text of a constant."""
    return _sql_lit('"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"')


class _Names:
    def __init__(self):
        self.n = 0

    def __call__(self, prefix: str) -> str:
        self.n += 1
        return f"{prefix}{self.n}"


def _let_sql(g: _Names, value: str, body) -> str:
    v = g("v")
    return f"get(transform(array({value}), {v} -> {body(v)}), 0)"


def _quote_sql(g: _Names, x: str) -> str:
    return _let_sql(g, f"to_json(array({x}))", lambda w: f"substring({w}, 2, length({w}) - 2)")


def _sens_sql(key: str) -> str:
    return "(" + " OR ".join(f"contains(lower({key}), {_sql_lit(s)})" for s in SENSITIVE_BODY_KEYS) + ")"


def _number_sql(g: _Names, raw: str) -> str:
    """Number text as JavaScript writes the double it stands for.

    Whole numbers of up to 15 digits stay as they are. Of the others the shortest digits that still
    give the double are taken: Java's digits, rounded to the first length that reads back the same
    (older JVMs print one digit too many now and then). With the point before them they have the exponent ``n``;
    up to 21 whole digits and up to 6 zeros behind the point are written out. Infinite: ``null``.
    """
    def digits(t):
        """struct(d: digits without leading zeros, n: exponent) of Java's text."""
        mantissa = f"split_part({t}, 'E', 1)"
        return _let_sql(g, f"replace({mantissa}, '.', '')", lambda m: (
            f"named_struct('d', ltrim('0', {m}), 'n', instr({mantissa}, '.') - 1 - length({m}) + length(ltrim('0', {m})) "
            f"+ coalesce(try_cast(nullif(split_part({t}, 'E', 2), '') AS INT), 0))"))

    def shortest(x):
        def rounded(w):
            k, z = g("k"), g("z")
            unit = f"CAST(pow(10, length({w}.d) - {k}) AS BIGINT)"
            # two texts of up to 15 digits never mean the same double, but for those below the normal range
            first = f"CASE WHEN length({w}.d) > 15 OR {x} < 2.3E-308D THEN 1 ELSE length({w}.d) END"
            tries = (f"transform(sequence({first}, length({w}.d)), {k} -> named_struct("
                     f"'d', CAST((CAST({w}.d AS BIGINT) + {unit} DIV 2) DIV {unit} AS STRING), 'e', {w}.n - {k}))")
            return f"get(filter({tries}, {z} -> CAST(concat({z}.d, 'E', {z}.e) AS DOUBLE) = {x}), 0)"
        return _let_sql(g, digits(f"CAST({x} AS STRING)"), rounded)

    def written(b):
        d, n = f"rtrim('0', {b}.d)", f"({b}.e + length({b}.d))"
        return (f"CASE WHEN {n} BETWEEN length({d}) AND 21 THEN rpad({d}, {n}, '0') "
                f"WHEN {n} BETWEEN 1 AND 21 THEN concat(substring({d}, 1, {n}), '.', substring({d}, {n} + 1)) "
                f"WHEN {n} BETWEEN -5 AND 0 THEN concat('0.', repeat('0', -{n}), {d}) "
                f"ELSE concat(substring({d}, 1, 1), CASE WHEN length({d}) > 1 THEN '.' ELSE '' END, substring({d}, 2), "
                f"CASE WHEN {n} > 0 THEN 'e+' ELSE 'e' END, {n} - 1) END")

    def text(x):
        return (f"CASE WHEN {x} IS NULL OR isnan({x}) OR abs({x}) = double('Infinity') THEN 'null' WHEN {x} = 0 THEN '0' "
                f"ELSE concat(CASE WHEN {x} < 0 THEN '-' ELSE '' END, "
                + _let_sql(g, f"abs({x})", lambda a: _let_sql(g, shortest(a), written)) + ") END")
    return (f"CASE WHEN rlike({raw}, '^(0|-?[1-9][0-9]{{0,14}})$') THEN {raw} "
            f"ELSE {_let_sql(g, f'try_cast({raw} AS DOUBLE)', text)} END")


def _cut_sql(g: _Names, raw: str) -> str:
    """Strings beyond MAX_STRING UTF-16 units are cut, without half a character at the end; as ``text.shorten``."""
    def prefix(u):
        last = f"hex(substring({u}, {2 * MAX_STRING - 1}, 1))"
        whole = f"CASE WHEN {last} BETWEEN 'D8' AND 'DB' THEN substring({u}, 1, {2 * MAX_STRING - 2}) " \
                f"ELSE substring({u}, 1, {2 * MAX_STRING}) END"
        return (f"CASE WHEN octet_length({u}) > {2 * MAX_STRING} THEN concat(decode({whole}, 'UTF-16BE'), "
                f"{_sql_lit(TRUNCATED_SUFFIX)}) ELSE {raw} END")
    # no text has more units than bytes, and none has fewer than characters
    units = f"encode(substring({raw}, 1, {MAX_STRING + 1}), 'UTF-16BE')"
    return (f"CASE WHEN octet_length({raw}) <= {MAX_STRING} THEN {raw} "
            f"ELSE {_let_sql(g, units, prefix)} END")


def _value_sql(g: _Names, raw: str, vtype: str, depth: int) -> str:
    if depth >= MAX_DEPTH:
        return _json_text(DEPTH_MARK)
    cut = _cut_sql(g, raw)
    return (f"CASE WHEN {raw} IS NULL OR {vtype} IS NULL OR {vtype} = 'VOID' THEN 'null' "
            f"WHEN {vtype} = 'STRING' THEN {_quote_sql(g, cut)} "
            f"WHEN startswith({vtype}, 'ARRAY') THEN {_array_sql(g, raw, depth)} "
            f"WHEN startswith({vtype}, 'OBJECT') THEN {_object_sql(g, raw, depth)} "
            f"WHEN {vtype} = 'BOOLEAN' THEN {raw} ELSE {_number_sql(g, raw)} END")


def _array_sql(g: _Names, raw: str, depth: int) -> str:
    texts = f"slice(from_json({raw}, 'array<string>'), 1, {MAX_ARRAY})"
    if depth + 1 >= MAX_DEPTH:
        x = g("x")
        items = f"transform({texts}, {x} -> {_json_text(DEPTH_MARK)})"
    else:
        t = g("t")
        types = f"slice(transform(from_json({raw}, 'array<variant>'), {t} -> schema_of_variant({t})), 1, {MAX_ARRAY})"

        def each(ts):
            x, i = g("x"), g("i")
            return f"transform({texts}, ({x}, {i}) -> {_value_sql(g, x, f'get({ts}, {i})', depth + 1)})"
        items = _let_sql(g, types, each)
    return f"concat('[', array_join({items}, ',', 'null'), ']')"


def _object_sql(g: _Names, raw: str, depth: int) -> str:
    strings = f"from_json({raw}, 'map<string,string>')"
    e, i = g("e"), g("i")
    if depth + 1 >= MAX_DEPTH:
        entries = (f"transform(map_entries({strings}), {e} -> named_struct('key', {e}.key, 'value', {e}.value, "
                   f"'vtype', CAST(NULL AS STRING), 'sens', {_sens_sql(f'{e}.key')}))")
    else:
        k, v = g("k"), g("v")
        types = f"map_values(transform_values(from_json({raw}, 'map<string,variant>'), ({k}, {v}) -> schema_of_variant({v})))"
        entries = _let_sql(g, types, lambda ts: (
            f"transform(map_entries({strings}), ({e}, {i}) -> named_struct('key', {e}.key, 'value', {e}.value, "
            f"'vtype', get({ts}, {i}), 'sens', {_sens_sql(f'{e}.key')}))"))

    def render(es):
        a, j = g("a"), g("j")
        first_cut = f"array_position(transform({es}, ({a}, {j}) -> {j} >= {MAX_KEYS} AND NOT {a}.sens), true)"

        def with_cut(c):
            b = g("b")
            kept = f"CASE WHEN {c} > 0 THEN slice({es}, 1, {c} - 1) ELSE {es} END"
            child = _json_text(DEPTH_MARK) if depth + 1 >= MAX_DEPTH else \
                _value_sql(g, f"{b}.value", f"{b}.vtype", depth + 1)
            pairs = (f"transform({kept}, {b} -> concat({_quote_sql(g, f'{b}.key')}, ':', "
                     f"CASE WHEN {b}.sens THEN {_json_text(REDACTED)} ELSE {child} END))")
            marker = _sql_lit(f'"{TOO_MANY_KEYS_KEY}":"{TOO_MANY_KEYS}"')
            tail = f"CASE WHEN {c} > 0 THEN array({marker}) ELSE CAST(array() AS array<string>) END"
            return "concat('{', array_join(concat(" + pairs + ", " + tail + "), ','), '}')"
        return _let_sql(g, first_cut, with_cut)
    def once(es):
        """Of entries with the same key the last one, at the place of the first."""
        a, b, n = g("a"), g("b"), g("n")
        names = f"array_distinct(transform({es}, {a} -> {a}.key))"
        return (f"CASE WHEN size({names}) = size({es}) THEN {es} ELSE "
                f"transform({names}, {n} -> element_at(filter({es}, {b} -> {b}.key = {n}), -1)) END")

    def ordered(es):
        """Keys that are array indices come first, by their number; the others keep their order."""
        def index(key):
            return f"(rlike({key}, '^(0|[1-9][0-9]{{0,9}})$') AND CAST({key} AS BIGINT) < {MAX_INDEX_KEY})"
        a, b, c, n = g("a"), g("b"), g("c"), g("n")
        numbers = (f"array_sort(transform(filter({es}, {b} -> {index(f'{b}.key')}), "
                   f"{c} -> named_struct('n', CAST({c}.key AS BIGINT), 'entry', {c})))")
        return (f"CASE WHEN exists({es}, {a} -> {index(f'{a}.key')}) THEN concat(transform({numbers}, {n} -> {n}.entry), "
                f"filter({es}, {a} -> NOT {index(f'{a}.key')})) ELSE {es} END")

    return _let_sql(g, entries, lambda es: _let_sql(g, once(es), lambda o: _let_sql(g, ordered(o), render)))


def sanitize_json_sql(body: str) -> str:
    """SQL text of the sanitiser for the SQL expression ``body`` (e.g. a column name)."""
    g = _Names()
    alone = f"try_parse_json(concat('[', {body}, ']'))"  # as in is_valid_json
    parsed = (f"try_parse_json(CASE WHEN {alone} IS NOT NULL AND try_variant_get({alone}, '$[1]', 'variant') IS NULL "
              f"THEN {body} END)")
    trimmed = f"btrim({body}, {_sql_lit(JS_SPACE_CHARS)})"

    def top(t):
        raw = f"CASE WHEN {t} = 'STRING' THEN try_variant_get({parsed}, '$', 'string') ELSE {trimmed} END"
        return f"CASE WHEN {t} IS NULL THEN CAST(NULL AS STRING) ELSE " + \
            _let_sql(g, raw, lambda r: _value_sql(g, r, t, 0)) + " END"
    return _let_sql(g, f"schema_of_variant({parsed})", top)


def sanitize_json(body) -> Column:
    """Redact, cut and depth-limit a JSON text; returns compact JSON text.

    Objects keep key order (whole-number keys first, as in JavaScript); sensitive keys -> "[REDACTED]"; > 50 keys -> cut with
    a "..." marker; arrays keep 10 items; strings keep 1000 UTF-16
    units; numbers are written as JavaScript writes them; anything at depth 3 becomes "[Max Depth Reached]". Null or invalid JSON -> null.
    ``body`` is a column name (quoted with backticks here) or a SQL expression string.
    """
    if not isinstance(body, str):
        raise TypeError("sanitize_json takes a column name; add computed bodies with withColumn first")
    ref = body if ("(" in body or "`" in body) else f"`{body}`"
    return F.expr(sanitize_json_sql(ref))


def parse_response(body: str) -> Column:
    """Response body for the audit record: JSON -> sanitised; text -> first 500 chars; empty -> null.

    ``body`` is a column name."""
    c = F.col(body)
    return (F.when(c.isNull() | (c == ""), F.lit(None).cast("string"))
            .when(is_valid_json(c), sanitize_json(body))
            .otherwise(json_quote(utf16_prefix(c, MAX_RAW_RESPONSE))))


# --- request summary and response shape -------------------------------------

def request_summary(body, api_key_header=None) -> Column:
    """struct(body_kind, n_keys, keys, api_key) describing a request for the error log."""
    body = _c(body)
    keys = F.json_object_keys(body)
    parts = [json_kind(body).alias("body_kind"),
             F.coalesce(F.size(keys), F.lit(0)).alias("n_keys"),
             F.coalesce(F.array_join(keys, ","), F.lit("")).alias("keys")]
    if api_key_header is not None:
        h = _c(api_key_header)
        parts.append(F.when(h.isNotNull() & (h != ""), "present").otherwise("missing").alias("api_key"))
    return F.struct(*parts)


# Result contracts: path that must hold an array / object, per reply kind.
RESULT_SHAPES = {
    "keywords": (("$.present_skills", "ARRAY"), ("$.missing_skills", "ARRAY")),
    "experience": (("$.enhanced_experience", "ARRAY"),),
    "resume": (("$.formatted_resume", "OBJECT"), ("$.formatted_resume.skills", "ARRAY")),
    "coverletter": (("$.cover_letter", "OBJECT"),),
}


def check_shape(payload, kind: str) -> Column:
    """True when the parsed reply carries the containers its contract requires."""
    v = F.try_parse_json(_c(payload))
    ok = F.lit(True)
    for path, container in RESULT_SHAPES[kind]:
        t = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
        ok = ok & F.coalesce(t.startswith(container), F.lit(False))
    return ok
