"""Reply contracts as data: the contract texts read into types, replies checked against them.

A contract text either declares types (``Name { field: type }``, with ``string``, other names and ``[]``; ``Response``
is the reply) or shows the reply as a JSON example. The texts are those that prompts carry, so what the
model is told is what its reply is held to.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .prompt_texts import COVERLETTER_SCHEMA, EXPERIENCE_SCHEMA, KEYWORDS_SCHEMA, RESUME_SCHEMA

STRING = "string"
_BLOCK = re.compile(r"(\w+)\s*\{([^{}]*)\}")
_FIELD = re.compile(r"(\w+)\s*:\s*(\w+)((?:\[\])*)")

# a type is STRING, ("array", type) or ("object", {field: type})
Type = str | tuple


def declared(text: str) -> dict[str, str]:
    """Name -> fields of the types that a text declares."""
    return {name: body for name, body in _BLOCK.findall(text) if _FIELD.search(body)}


def resolved(name: str, types: dict[str, str]) -> Type:
    fields = {}
    for field, base, arrays in _FIELD.findall(types[name]):
        t: Type = STRING if base == STRING else resolved(base, types)
        for _ in range(len(arrays) // 2):
            t = ("array", t)
        fields[field] = t
    return "object", fields


def of_example(value) -> Type:
    if isinstance(value, dict):
        return "object", {k: of_example(v) for k, v in value.items()}
    return ("array", of_example(value[0])) if isinstance(value, list) else STRING


def contracts() -> dict[str, Type]:
    """Kind of reply -> its type. Types declared by one text may be used by another."""
    texts = {"experience": EXPERIENCE_SCHEMA, "resume": RESUME_SCHEMA, "coverletter": COVERLETTER_SCHEMA}
    shared = {k: v for t in texts.values() for k, v in declared(t).items() if k != "Response"}
    out = {kind: resolved("Response", {**shared, **declared(text)}) for kind, text in texts.items()}
    example = KEYWORDS_SCHEMA[KEYWORDS_SCHEMA.index("{"): KEYWORDS_SCHEMA.index("}") + 1]
    return {"keywords": of_example(json.loads(example)), **out}


def paths(t: Type, at: str = "$") -> list[tuple[str, str]]:
    """(path, type name) of a type and all below it; ``[]`` stands for any position."""
    if t == STRING:
        return [(at, STRING)]
    kind, inner = t
    below = paths(inner, f"{at}[]") if kind == "array" else [p for f, x in inner.items() for p in paths(x, f"{at}.{f}")]
    return [(at, kind), *below]


def _none() -> Column:
    return F.array().cast("array<string>")


def _broken(v: Column, at: Column, t: Type) -> Column:
    kind = t if t == STRING else t[0]
    found = F.schema_of_variant(v)
    if kind == STRING:
        right, below = found == "STRING", _none()
    elif kind == "array":
        right = found.startswith("ARRAY")
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: _broken(
            x, F.concat(at, F.lit("["), i.cast("string"), F.lit("]")), t[1]))
        below = F.flatten(items)
    else:
        right = found.startswith("OBJECT")
        below = F.concat(*[_broken(F.try_variant_get(v, f"$.{f}", "variant"), F.concat(at, F.lit(f".{f}")), x)
                           for f, x in t[1].items()])
    article = "an" if kind[0] in "ao" else "a"
    return (F.when(v.isNull(), F.array(F.concat(at, F.lit(": missing"))))
            .when(~right, F.array(F.concat(at, F.lit(f": not {article} {kind}")))).otherwise(below))


def broken_paths(payload: Column, kind: Column) -> Column:
    """Every place where a reply departs from its kind's contract, in order of their paths; none if it keeps it.

    A text that is no JSON lacks the whole reply; a kind without a contract gives null.
    """
    def held(t: Type) -> Column:  # parsed once
        return F.get(F.transform(F.array(F.try_parse_json(payload)), lambda v: _broken(v, F.lit("$"), t)), 0)
    cases = reduce(lambda c, item: c.when(kind == item[0], held(item[1])), contracts().items(), F)
    return F.array_sort(cases)
