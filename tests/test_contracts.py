"""Reply contracts: read from their texts, and every broken path named."""

import json

from core_helpers import evaluate
from pyspark.sql import functions as F

from jobledger.functions.contracts import broken_paths, contracts, paths
from jobledger.operators.profiles import array_or_empty, json_or


def test_contracts_are_read_from_their_texts():
    found = {kind: dict(paths(t)) for kind, t in contracts().items()}
    assert found["keywords"] == {"$": "object", "$.present_skills": "array", "$.present_skills[]": "string",
                                 "$.missing_skills": "array", "$.missing_skills[]": "string"}
    entry = {"[]": "object", "[].company": "string", "[].position": "string", "[].description": "array", "[].description[]": "string"}
    assert found["experience"] == {"$": "object", "$.enhanced_experience": "array",
                                   **{f"$.enhanced_experience{k}": v for k, v in entry.items()}}
    assert {f"$.formatted_resume.experience{k}": v for k, v in entry.items()}.items() <= found["resume"].items()
    assert len(found["coverletter"]) == 10


def brute(value, t, at="$"):
    if t == "string":
        return [] if isinstance(value, str) else [f"{at}: not a string"]
    if t[0] == "array":
        if not isinstance(value, list):
            return [f"{at}: not an array"]
        return [b for i, x in enumerate(value) for b in brute(x, t[1], f"{at}[{i}]")]
    if not isinstance(value, dict):
        return [f"{at}: not an object"]
    return [b for f, x in t[1].items() for b in (brute(value[f], x, f"{at}.{f}") if f in value else [f"{at}.{f}: missing"])]


def test_broken_paths_equal_a_walk(spark):
    values = [{}, [], "x", 1, True, {"formatted_resume": {"name": "n", "position": "p", "experience": [], "skills": []}},
              {"formatted_resume": {"name": 1, "experience": [{"company": "c", "description": ["d", 2, []]}, 7], "skills": "s"}},
              {"formatted_resume": []}, {"present_skills": [["a"], {}], "missing_skills": ["a"]},
              {"enhanced_experience": [{"company": "c", "position": "p", "description": []}]}]
    for kind, t in contracts().items():
        got = evaluate(spark, lambda df: broken_paths(F.col("x"), F.lit(kind)), [json.dumps(v) for v in values])  # noqa: B023
        assert got == [sorted(brute(v, t)) for v in values]
    assert evaluate(spark, lambda df: broken_paths(F.col("x"), F.lit("keywords")), ["no json", None]) == [["$: missing"]] * 2
    assert evaluate(spark, lambda df: broken_paths(F.col("x"), F.lit("other")), ["{}"]) == [None]


def test_stored_sections_fall_back_as_falsy_values_do(spark):
    values = [None, "null", "false", "0", "0.0", '""', "no json", "[]", "{}", '"false"', '"0"', "true", "2", "[0]"]
    got = evaluate(spark, lambda df: json_or(F.col("x"), "D"), values)
    assert got == ["D"] * 7 + values[7:]
    assert evaluate(spark, lambda df: array_or_empty(F.col("x")), values) == [v if v in ("[]", "[0]") else "[]" for v in values]
