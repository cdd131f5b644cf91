"""Golden vectors for the scalar rules (hand-derived from the service's rules)."""

from pyspark.sql import functions as F

from core_helpers import evaluate
from jobledger.functions import jsonx, rules, text
from jobledger.operators import usage


def test_title_filter(spark):
    vals = ["Data Engineer", " Staff Nurse ", "QA", "12-34.", "A1B2C3", "Cover Letter Generator",
            "Update Resource Planner", "Senior update terms lead", None, "a" * 200, "a" * 201,
            "Keywords & Skills Analyzer", "Senior cover letter generator", "update terms manager"]
    exp = [True, True, False, False, False, False, False, False, False, True, False, False, False, False]
    assert evaluate(spark, lambda d: rules.is_job_title(F.col("x")), vals) == exp


def test_title_trim_unicode(spark):
    # JS trim strips NBSP / tabs; " QA\t" is two letters after trimming
    assert evaluate(spark, lambda d: rules.is_job_title(F.col("x")), [" QA\t", "\tNurse "]) == [False, True]


def test_service_name(spark):
    vals = ["/api/chat", "/chat", "/api/applied-jobs/7/status", "/api/usage/daily", "/api/user-skills", "/", "/apix"]
    exp = ["CHAT", "CHAT", "APPLIED_JOBS", "USAGE", "USER-SKILLS", "UNKNOWN", "X"]
    assert evaluate(spark, lambda d: rules.service_name(F.col("x")), vals) == exp


def test_normalize_skill(spark):
    assert evaluate(spark, lambda d: text.normalize_skill(F.col("x")), ["Node.js", " C++ ", "***"]) == ["nodejs", "c", ""]


def test_split_name(spark):
    out = evaluate(spark, lambda d: text.split_name(F.col("x")), [None, "Cher", "  Ann  B  Lee", "   "])
    assert [tuple(r) for r in out] == [("", ""), ("Cher", ""), ("Ann B", "Lee"), ("", "")]


def test_slug_name(spark):
    vals = ["https://www.linkedin.com/in/jane-mcDoe-9/", "https://www.linkedin.com/in/martin/", "https://x.com/in/a-b",
            None, "https://linkedin.com/in/a-/"]
    out = evaluate(spark, lambda d: text.name_from_slug(F.col("x")), vals)
    assert [tuple(r) for r in out] == [("Jane", "McDoe"), (None, None), (None, None), (None, None), ("A", "")]


def test_search_string(spark):
    out = evaluate(spark, lambda d: text.search_string(F.col("c"), F.col("k"), F.col("l")),
                   [("Acme", "linkedin", "Oslo"), ("Acme", "website", None), ("Acme", "other", "Oslo"),
                    ("Acme", "hr_linkedin", "")], "c string, k string, l string")
    assert out == ["site:linkedin.com/company/ Acme Oslo", "Acme website", None,
                   'site:linkedin.com/in/ "HR Manager" OR "Human Resources" OR "Talent Acquisition" "Acme"']


def test_csv_cell(spark):
    assert evaluate(spark, lambda d: text.csv_cell(F.col("x")), ['a"b', "a,b", None, "a b", "l1\nl2"]) == \
        ['"a""b"', '"a,b"', "", "a b", '"l1\nl2"']


def test_error_fields(spark):
    rows = [(0, 200, '{"errorCode":"X"}'), (1, 401, '{"message":"m"}'),
            (2, 400, '{"errorCode":"","error_code":"E","error":"x"}'), (3, 503, "not json"),
            (4, 500, '{"errorCode":"X","message":"m"} trailing'), (5, 500, "{'errorCode':'X'}"),
            (6, 400, '{"errorCode":"A","errorCode":"B"}')]
    df = spark.createDataFrame(rows, "i int, s int, b string")
    out = jsonx.with_error_fields(df, "s", "b").orderBy("i").collect()
    assert [(r.error_code, r.error_message) for r in out] == [
        (None, None), ("HTTP_401", "m"), ("E", "x"), ("HTTP_503", None), ("HTTP_500", None), ("HTTP_500", None), ("B", None)]


def test_error_title(spark):
    assert evaluate(spark, lambda d: text.error_title(F.col("x")), ["AI_SERVICE_ERROR", "HTTP_401", "abc_DEF"]) == \
        ["Ai Service Error", "Http 401", "abc Def"]


def test_extract_json(spark):
    vals = ['x ```json {"a":1} ``` y', '{"a":1}', 'Answer: {"a":1}', "none", '```json {bad ``` then {"a":1}']
    df = spark.createDataFrame(list(enumerate(vals)), "i int, x string")
    strict, lenient = ([(r.status, r.payload) for r in jsonx.extract_json_columns(df, "x", way).orderBy("i").collect()]
                       for way in (False, True))
    assert [tuple(r) for r in strict] == [("ok", '{"a":1}'), ("ok", '{"a":1}'), ("no_json", None),
                                          ("no_json", None), ("bad_block", None)]
    assert [tuple(r) for r in lenient] == [("ok", '{"a":1}'), ("ok", '{"a":1}'), ("ok", '{"a":1}'),
                                           ("no_json", None), ("bad_block", None)]


def test_duplicate_keys_last_wins(spark):
    vals = ['{"a":1,"a":2}', '```json {"a":1,"a":2} ```', '{"a":1} {"b":2}', "1,2", "1"]
    df = spark.createDataFrame(list(enumerate(vals)), "i int, x string")
    got = [r.status for r in jsonx.extract_json_columns(df, "x").orderBy("i").collect()]
    assert got == ["ok", "ok", "no_json", "no_json", "ok"]
    bodies = ['{"password":"hunter2","password":"hunter3","a":1}', '{"a":1,"b":{"x":1,"x":2},"a":3}', "plain",
              '{"password":"x"} y']
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, b string")
    got = [r.v for r in df.select("i", jsonx.parse_response("b").alias("v")).orderBy("i").collect()]
    assert got[:3] == ['{"password":"[REDACTED]","a":1}', '{"a":3,"b":{"x":2}}', '"plain"']


def test_text_stats(spark):
    out = evaluate(spark, lambda d: text.text_stats(F.col("x")), ["", "a b", " a ", "a b"])
    assert [(r.chars, r.words, r.est_tokens) for r in out] == [(0, 1, 2), (3, 2, 3), (3, 3, 4), (3, 2, 3)]


def test_alert_label_and_short_message(spark):
    base = dict(service=F.lit("CHAT"), code=F.lit("AI_SERVICE_ERROR"), status=F.lit(502), path=F.lit("/api/chat"))
    out = evaluate(spark, lambda d: rules.alert_text(base["service"], base["code"], F.col("m"), base["status"],
                                                     F.col("e"), F.col("u"), base["path"]),
                   [("x" * 100, "a@b.c", None), ("x" * 101, None, "abcdefghijklmnop"), (None, None, None)],
                   "m string, e string, u string")
    assert "*User:* a@b.c" in out[0] and ("x" * 100) in out[0]
    assert "*User:* User ID: abcdefghijkl..." in out[1] and ("x" * 97 + "...") in out[1]
    assert "*User:* Not yet logged in" in out[2] and "An error occurred" in out[2]


def test_quota(spark):
    out = evaluate(spark, lambda d: F.struct(*usage.quota(F.col("n"))), [0, 19, 20, 25], "n long")
    assert [(r.remaining, r.exceeded) for r in out] == [(20, False), (1, False), (0, True), (0, True)]


def test_origin(spark):
    vals = [None, "chrome-extension://x", "http://localhost:5", "http://localhost", "moz-extension://y"]
    assert evaluate(spark, lambda d: rules.origin_class(F.col("x")), vals) == \
        ["none", "chrome_extension", "localhost", "other", "firefox_extension"]


def test_retryable(spark):
    out = evaluate(spark, lambda d: rules.is_retryable(F.col("m"), None, F.col("s")),
                   [("Model OVERLOADED", None), ("x", 429), ("429", None)], "m string, s int")
    assert out == [True, True, False]


def test_classify_error(spark):
    rows = [("PrismaClientKnownRequestError", "P2002", "m"), ("PrismaClientKnownRequestError", "P9999", "m"),
            ("Error", "P1001", "m"), ("SyntaxError", None, "bad JSON"), ("Error", "LIMIT_FILE_SIZE", "m"),
            ("Error", None, "API key is required"), ("Error", None, "boom")]
    out = evaluate(spark, lambda d: rules.classify_error(F.col("n"), F.col("c"), F.col("m")), rows,
                   "n string, c string, m string")
    assert [tuple(r) for r in out] == [("DUPLICATE_ENTRY", 409), ("DATABASE_ERROR", 500), ("DATABASE_ERROR", 500),
                                       ("VALIDATION_ERROR", 400), ("FILE_TOO_LARGE", 413), ("AUTH_ERROR", 401),
                                       ("INTERNAL_SERVER_ERROR", 500)]


def test_status_for_code(spark):
    out = evaluate(spark, lambda d: rules.status_for_code(F.col("c"), F.col("s")),
                   [("AI_TIMEOUT", None), ("NOPE", None), ("NOT_FOUND", 418)], "c string, s int")
    assert out == [504, 500, 418]


def test_dates(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 0), dt.datetime(2024, 1, 1, 0, 0, 1, 250000))],
                               "a timestamp_ntz, b timestamp_ntz")
    r = df.select(text.duration_ms("a", "b").alias("ms"), text.iso_text("b").alias("iso")).first()
    assert r.ms == 1250 and r.iso == "2024-01-01T00:00:01.250Z"


def test_lengths_and_cuts_count_utf16_units(spark):
    from jobledger.functions.text import shorten, text_stats, utf16_length, utf16_prefix
    values = ["", "ab", "a\U0001F600b", "\U0001F600" * 3, "é漢\U0001F600", None]
    units = [None if v is None else len(v.encode("utf-16-be")) // 2 for v in values]
    assert evaluate(spark, lambda df: utf16_length(F.col("x")), values) == units
    for n in (1, 2, 3, 4, 9):
        def cut(v):
            return None if v is None else v.encode("utf-16-be")[: 2 * n].decode("utf-16-be", "ignore")  # noqa: B023
        assert evaluate(spark, lambda df: utf16_prefix(F.col("x"), n), values) == [cut(v) for v in values]  # noqa: B023
        assert evaluate(spark, lambda df: shorten(F.col("x"), n, n, "…"), values) == [  # noqa: B023
            None if v is None else v if u <= n else cut(v) + "…" for v, u in zip(values, units)]
    assert evaluate(spark, lambda df: text_stats(F.col("x"))["chars"], values)[:5] == units[:5]


def test_catalogue_is_ordered_as_a_locale_does(spark):
    from jobledger.operators.catalogue import catalogue
    names = ["model-Z", "model-a", "model-é", "model-f", "model-A", "model-10", "model-2"]
    df = spark.createDataFrame([(n, "d", "x", 1, 2, ["gen"]) for n in names],
                               "name string, display_name string, description string, input_limit int, output_limit int, capabilities array<string>")
    got = [r.name for r in catalogue(df, "model", "gen").collect()]
    assert got == ["model-10", "model-2", "model-a", "model-A", "model-é", "model-f", "model-Z"]
