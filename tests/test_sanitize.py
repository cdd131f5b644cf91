"""The depth-3 body sanitiser against a brute-force Python model of the same rule."""

import json
import math
import re
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from core_helpers import SF_SMALL, evaluate
from jobledger.functions import jsonx

SENS = jsonx.SENSITIVE_BODY_KEYS


def model(v, d=0):
    if d >= 3:
        return "[Max Depth Reached]"
    if v is None:
        return None
    if isinstance(v, str):
        units = v.encode("utf-16-be")
        return units[:2000].decode("utf-16-be", "ignore") + "... [truncated]" if len(units) > 2000 else v
    if isinstance(v, float) and math.isinf(v):
        return None
    if isinstance(v, (bool, int, float)):
        return v
    if isinstance(v, list):
        return [model(x, d + 1) for x in v[:10]]
    out = {}
    index = sorted((k for k in v if re.fullmatch("0|[1-9][0-9]{0,9}", k) and int(k) < 2 ** 32 - 1), key=int)
    for k, val in [(k, v[k]) for k in index] + [(k, x) for k, x in v.items() if k not in index]:
        if any(s in k.lower() for s in SENS):
            out[k] = "[REDACTED]"
            continue
        if len(out) >= 50:
            out["..."] = "[Too many keys, truncated]"
            break
        out[k] = model(val, d + 1)
    return out


def pairs(text):
    return json.loads(text, object_pairs_hook=lambda kv: ("obj", kv))


def expected(body):
    try:
        parsed = json.loads(body)
    except (TypeError, ValueError):
        return None
    return json.dumps(model(parsed), separators=(",", ":"), ensure_ascii=False)


BODIES = [
    '{"monkey":1,"a":{"b":{"c":1}},"n":null}',
    '{"z":1,"a":"1","m":{"x":[1,"2",{"deep":true}],"y":null},"t":true,"f":1.5}',
    json.dumps({"arr": list(range(12)), "s": "x" * 1001, "q": 'he said "hi"\nnext'}),
    json.dumps({f"k{i:02d}": i for i in range(60)}),
    json.dumps({**{f"f{i:02d}": i for i in range(50)}, "token": "t", "password": "p", "after": 1, "z": 2}),
    json.dumps({**{f"f{i:02d}": i for i in range(49)}, "secret": "s", "x": {"apiKey": 1, "api_key": 2}}),
    '[1, {"a": {"b": 1}}, "s", null]',
    '"just a string"',
    '{"lvl1": {"lvl2": {"lvl3": null, "other": [1]}}}',
    "not json",
    None,
    '{"keywords": ["a"], "Authorization": "b", "X-Api-Key": "c", "name": "ok"}',
    '{"b":1,"10":2,"2":{"7":1,"x":2,"3":0.5},"01":3,"4294967295":4,"4294967294":5,"-1":6}',
    json.dumps({f"f{i:02d}": i for i in range(49)} | {"7": 1, "3": 2}),
    json.dumps({"emoji": "\U0001F600" * 501, "odd": "x" + "\U0001F600" * 500, "fits": "\U0001F600" * 500}),
    '{"beyond": 1e400, "below": -1e400}',
]


def test_sanitize_matches_model(spark):
    got = evaluate(spark, lambda d: jsonx.sanitize_json("x"), BODIES)
    for body, out in zip(BODIES, got):
        exp = expected(body)
        if exp is None:
            assert out is None, body
        else:
            assert out is not None, body
            assert pairs(out) == pairs(exp), (body, out, exp)


def test_sanitize_idempotent(spark):
    bodies = [b for b in BODIES if b]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, x string")
    s1 = df.select("i", jsonx.sanitize_json("x").alias("y"))
    s2 = s1.select("i", "y", jsonx.sanitize_json("y").alias("z")).orderBy("i").collect()
    once, twice = [r.y for r in s2], [r.z for r in s2]
    # the depth marker replaces level-3 values, so a second pass may only cut deeper content further
    for a, b in zip(once, twice):
        if a is not None and "[Max Depth Reached]" not in a and "truncated" not in a:
            assert pairs(a) == pairs(b)


def test_body_sanitize_query_matches_model(spark):
    import __spark_entry__ as E
    from jobledger.plans.catalog import doc_bodies
    got = {r.doc_id: r.sanitized for r in E.queries()["body_sanitize"](spark, SF_SMALL).collect()}
    bodies = {r.doc_id: r.body for r in doc_bodies(spark, SF_SMALL).collect()}
    assert got.keys() == bodies.keys() and len(got) > 0
    for k, body in bodies.items():
        assert pairs(got[k]) == pairs(expected(body)), k


def test_parse_response(spark):
    out = evaluate(spark, lambda d: jsonx.parse_response("x"), ["", None, "plain text " * 100, '{"password":"x"}'])
    assert out[0] is None and out[1] is None
    assert json.loads(out[2]) == ("plain text " * 100)[:500]
    assert json.loads(out[3]) == {"password": "[REDACTED]"}


def js_number(x):
    """Number text of the ECMAScript standard, from Python's shortest digits."""
    if math.isinf(x):
        return "null"
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(float(x))).normalize().as_tuple()
    s = "".join(map(str, digits))
    k, n = len(s), len(digits) + exponent
    if k <= n <= 21:
        out = s + "0" * (n - k)
    elif 0 < n <= 21:
        out = s[:n] + "." + s[n:]
    elif -6 < n <= 0:
        out = "0." + "0" * -n + s
    else:
        out = s[0] + ("." + s[1:] if k > 1 else "") + "e" + ("+" if n > 0 else "-") + str(abs(n - 1))
    return "-" * sign + out


NUMBERS = {"1e3": "1000", "1.0": "1", "1.50": "1.5", "-0": "0", "-0.0": "0", "1e21": "1e+21", "1e20": "1" + "0" * 20,
           "123e-20": "1.23e-18", "0.000001": "0.000001", "1e-7": "1e-7", "12345678901234567890": "12345678901234567000",
           "2E23": "2e+23", "1e23": "1e+23", "5e-324": "5e-324", "4.35": "4.35", "-1E5": "-100000",
           "5.684341886080802E-14": "5.684341886080802e-14", "9007199254740993": "9007199254740992",
           "1.7976931348623157e308": "1.7976931348623157e+308", "1e400": "null", "999999999999999": "999999999999999"}


def test_numbers_as_javascript_writes_them(spark):
    texts = list(NUMBERS)
    assert [js_number(float(t)) for t in texts] == [NUMBERS[t] for t in texts]
    assert evaluate(spark, lambda d: jsonx.sanitize_json("x"), texts) == [NUMBERS[t] for t in texts]
    finite = [t for t in texts if NUMBERS[t] != "null"]  # infinite ones inside a nested value become texts
    got = evaluate(spark, lambda d: jsonx.sanitize_json("x"),
                   [f"[{t}]" for t in finite] + [f'{{"a":{{"b":{t}}}}}' for t in finite])
    assert got == [f"[{NUMBERS[t]}]" for t in finite] + [f'{{"a":{{"b":{NUMBERS[t]}}}}}' for t in finite]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=200, max_size=400))
def test_any_double(spark, xs):
    assert evaluate(spark, lambda d: jsonx.sanitize_json("x"), [repr(x) for x in xs]) == [js_number(x) for x in xs]
