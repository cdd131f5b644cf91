"""Personal data: base patterns, and terms that give protected values away.

Base spans are e-mail addresses, IPv4 addresses, payment cards and phone numbers. Beyond them,
the corpus itself is asked which terms disclose a protected value (a base match): with a line as
context, N lines in all, n(c) with the value c, n(t) with the term t and n(c, t) with both,

    disclosure(c, t) = PMI(c, t) / IC(c) = (log n(c,t) + log N - log n(c) - log n(t)) / (log N - log n(c))

is 1 if the term occurs only beside the value, and 0 if it says nothing. Terms that reach
``threshold`` beside a value, in at least ``min_lines`` different lines, are spans too, in every
line of every document, with the value or without it (but not within a base span). ``sanitize``
generalises base spans to their kind and removes disclosing terms.

DataFrame functions only. Counts are summed by each task before they are shuffled, so a value or
term held by a third of all lines is one row per task; the joins are equi-joins on values, terms or
documents, which the planner broadcasts or splits by size. To find the disclosing terms' places,
a document's different words are compared with a bounded table of hash slots first, so that words
in no used slot are not shuffled. Texts are shuffled once, when they are joined with their terms,
unless those are few enough to be broadcast.

The patterns match as ``[...]+`` written plainly would, but possessively, and only from the start
of a run or the end of the last match, so that very long runs take linear time and no stack.

Defined cases: null text counts as empty; rows with null or repeated ids are treated alike, by id
and text; an empty table gives an empty result; further columns are ignored by ``spans`` and kept
by ``sanitize``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

THRESHOLD = 0.9
MIN_LINES = 3
SLOTS = 1 << 17  # rows of the broadcast table of disclosing terms' hash slots, at most

# The kinds in the order of their listing, and their patterns.
KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TERM = r"[\p{L}\p{M}\p{N}]++"
TAGS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": ""}


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(value, "[ -]", "")
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


_SPAN = "array<struct<start:int,stop:int,value:string>>"


def _matches(text: Column, pattern: str) -> tuple[Column, Column]:
    """(the pieces between matches, the matches): one entry more in the former."""
    hit = F.when(text.rlike(pattern), F.lit(True))
    return (F.when(hit, F.split(text, pattern, -1)),
            F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))


def _located(between: Column, matches: Column, wanted=lambda value: F.lit(True)) -> Column:
    """Spans of the wanted matches, from the lengths of what stands before them (code points)."""
    def step(acc, x):
        start = acc["at"] + F.length(x["0"])
        stop = start + F.length(x["1"])
        span = F.array(F.struct(start.alias("start"), stop.alias("stop"), x["1"].alias("value")))
        return F.when(x["1"].isNull(), acc).otherwise(
            F.struct(stop.alias("at"), F.when(wanted(x["1"]), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out")))

    pairs = F.arrays_zip(between.alias("0"), matches.alias("1"))
    none = F.array().cast(_SPAN)
    return F.coalesce(F.aggregate(F.transform(pairs, lambda x: F.struct(x["0"].alias("0"), x["1"].alias("1"))),
                                  F.struct(F.lit(0).alias("at"), none.alias("out")), step,
                                  lambda acc: acc["out"]), none)


def _base(df: DataFrame, text: str) -> DataFrame:
    """Adds ``base``: array of (start, kind_no, stop, kind, value), in order."""
    staged = df.withColumns({f"{part}_{k}": col for k in KINDS[:4]
                             for part, col in zip(("between", "match"), _matches(F.col(text), PATTERNS[k]))})
    staged = staged.withColumns({f"span_{k}": _located(F.col(f"between_{k}"), F.col(f"match_{k}"),
                                                       lambda value, k=k: _valid(k, value)) for k in KINDS[:4]})

    def of_kind(i: int, k: str) -> Column:
        return F.transform(f"span_{k}", lambda x: F.struct(
            x["start"].alias("start"), F.lit(i).alias("kind_no"), x["stop"].alias("stop"),
            F.lit(k).alias("kind"), x["value"].alias("value")))

    kinds = [of_kind(i, k) for i, k in enumerate(KINDS[:4])]
    return staged.withColumn("base", F.array_sort(F.concat(*kinds))).select(*df.columns, "base")


def _protected(value: Column, kind: Column) -> Column:
    """One spelling of a protected value: e-mail addresses in lower case, numbers as digits."""
    return F.concat(kind, F.lit(":"), F.when(kind.isin("email", "ip"), F.lower(value))
                    .otherwise(F.regexp_replace(value, "[^0-9]", "")))


def _key(text: str) -> Column:
    return F.xxhash64(F.col(text))


def _same(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on columns that may be null."""
    named = right.withColumnsRenamed({c: f"{c}_r" for c in on})
    cond = [F.col(c).eqNullSafe(F.col(f"{c}_r")) for c in on]
    return left.join(named, cond).drop(*[f"{c}_r" for c in on])


def disclosing(docs: DataFrame, id_col: str, text: str, threshold: float, min_lines: int) -> DataFrame:
    """page, text_key, terms: the words of a text that give a protected value away, as spelt there."""
    found = _base(docs.select(F.col(id_col).alias("page"), F.col(text).alias("text")), "text").filter(F.size("base") > 0)

    def line_start(b: Column) -> Column:
        return b["start"] - F.length(F.substring_index(F.substring(F.col("text"), F.lit(1), b["start"]), "\n", -1))

    def line(start: Column) -> Column:
        return F.substring_index(F.substring(F.col("text"), start + 1, F.length("text")), "\n", 1)

    found = found.withColumn("at", F.transform("base", line_start))
    found = found.withColumn("lines", F.transform(F.array_distinct("at"), lambda s: F.struct(
        s.alias("line_start"), line(s).alias("line"))))
    found = found.withColumn("values", F.array_distinct(F.transform(F.arrays_zip("at", "base"), lambda x: F.struct(
        x["at"].alias("line_start"), _protected(x["base"]["value"], x["base"]["kind"]).alias("c")))))
    found = written(found.select(
        "page", _key("text").alias("text_key"), "lines", "values",
        F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["stop"].alias("stop"))).alias("base"),
    ).dropDuplicates(["page", "text_key"]), "protected")

    where = ["page", "text_key", "line_start"]
    values = found.select("page", "text_key", F.explode("values").alias("v")).select("page", "text_key", "v.*")
    lines = found.select("page", "text_key", "base", F.explode("lines").alias("x")).select("page", "text_key", "base", "x.*")
    lines = lines.withColumn("l", F.xxhash64("line"))
    placed = _same(values, lines.select(*where, "l"), where)
    frequent = (placed.select("c", "l").distinct().groupBy("c").count()
                .filter(F.col("count") >= min_lines).select("c"))
    kept = written(placed.join(frequent, "c"), "protected-values")  # where, c, l

    between, match = _matches(F.col("line"), TERM)
    words = (_same(lines.drop("l"), kept.select(*where).distinct(), where)
             .withColumn("between", between).withColumn("match", match)
             .withColumn("words", _located(F.col("between"), F.col("match"))))
    words = words.withColumn("words", F.filter("words", lambda w: ~F.exists("base", lambda b: (
        b["start"] < F.col("line_start") + w["stop"]) & (b["stop"] > F.col("line_start") + w["start"]))))
    words = words.select(*where, F.explode("words").alias("word")).select(*where, F.lower("word.value").alias("t"))
    words = written(_same(words, kept, where).select(*where, "c", "l", "t"), "protected-words")

    each = words.groupBy("c", "t", "page", "text_key", "line_start").agg(F.first("l").alias("l"))
    support = (each.groupBy("c", "t", "l").agg(F.count(F.lit(1)).alias("n"))
               .groupBy("c", "t").agg(F.sum("n").alias("n_ct"), F.count(F.lit(1)).alias("different"))
               .filter(F.col("different") >= min_lines))
    n_c = kept.groupBy("c").agg(F.count(F.lit(1)).alias("n_c"))

    all_lines = docs.select(F.explode(F.split(F.col(text), "\n", -1)).alias("line"))
    n_t = (all_lines.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit(TERM), F.lit(0)))).alias("t"))
           .groupBy("t").agg(F.count(F.lit(1)).alias("n_t")))
    total = all_lines.filter(F.length("line") > 0).agg(F.count(F.lit(1)).alias("n")).first()["n"]

    log_n = F.log(F.lit(float(max(total, 2))))
    # n_ct and n_c count a repeated row once, n_t each time; n_t is at least n_ct
    share = F.least(F.col("n_ct").cast("double"), F.col("n_t").cast("double"))
    disclosure = ((F.log(share) + log_n - F.log("n_c") - F.log("n_t")) / (log_n - F.log("n_c")))
    flagged = (support.join(n_c, "c").join(n_t, "t").filter(F.col("n_c") < total)
               .withColumn("disclosure", disclosure).filter(F.col("disclosure") >= threshold))
    flagged = written(flagged.select("t").distinct(), "flagged")

    slot = F.xxhash64("t").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")
    everywhere = docs.select(F.col(id_col).alias("page"), _key(text).alias("text_key"), F.explode(
        F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(TERM), F.lit(0)))).alias("word"))
    everywhere = everywhere.withColumn("t", F.lower("word"))
    likely = everywhere.select("*", slot).join(F.broadcast(flagged.select(slot).distinct()), "slot", "left_semi")
    marked = likely.join(flagged, "t", "left_semi")
    return written(marked.groupBy("page", "text_key").agg(F.collect_set("word").alias("terms")), "terms")


def _with_spans(docs: DataFrame, id_col: str, text: str, threshold: float, min_lines: int) -> DataFrame:
    """``docs`` with ``base`` and ``all_spans``; ``text`` must not be null."""
    terms = disclosing(docs, id_col, text, threshold, min_lines).withColumnsRenamed({"page": "t_page", "text_key": "t_key"})
    keyed = docs.withColumn("__key", _key(text))
    joined = keyed.join(terms, F.col(id_col).eqNullSafe(F.col("t_page")) & (F.col("__key") == F.col("t_key")), "left")
    based = _base(joined.drop("t_page", "t_key", "__key"), text)
    some = F.col("terms").isNotNull()
    between, match = _matches(F.col(text), TERM)
    based = based.withColumns({"between": F.when(some, between), "match": F.when(some, match)})
    based = based.withColumn("words", _located(F.col("between"), F.col("match"), lambda w: F.array_contains("terms", w)))
    free = F.filter("words", lambda w: ~F.exists("base", lambda b: (b["start"] < w["stop"]) & (b["stop"] > w["start"])))
    found = F.transform(free, lambda x: F.struct(x["start"].alias("start"), F.lit(4).alias("kind_no"),
                                                 x["stop"].alias("stop"), F.lit("term").alias("kind")))
    plain = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind_no"].alias("kind_no"),
                                                   x["stop"].alias("stop"), x["kind"].alias("kind")))
    return based.withColumn("all_spans", F.when(some, F.array_sort(F.concat(plain, found))).otherwise(plain)) \
                .drop("terms", "between", "match", "words")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
          min_lines: int = MIN_LINES) -> DataFrame:
    """id, n_<kind> of the base kinds, ``base`` and ``spans`` as kind:start:stop, in order."""
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = _with_spans(plain, "id", "text", threshold, min_lines)
    return found.select(
        F.col("id").alias(id_col),
        *[_count(k).alias(f"n_{k}") for k in KINDS[:4]],
        _joined("base").alias("base"), _joined("all_spans").alias("spans"))


def sanitize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
             min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` with every span of the text generalised (base kinds) or removed (terms)."""
    names = docs.columns
    at = {c: f"c{names.index(c)}" for c in (id_col, text_col)}
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    plain = plain.withColumn("body", F.coalesce(F.col(at[text_col]).cast("string"), F.lit("")))
    found = _with_spans(plain, at[id_col], "body", threshold, min_lines)
    body = F.col("body")

    def step(acc, x):
        tag = F.lit("")
        for kind, sign in TAGS.items():
            tag = F.when(x["kind"] == kind, F.lit(sign)).otherwise(tag)
        gap = F.substring(body, acc["at"] + 1, x["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"),
                        F.when(x["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], gap, tag)).alias("out"))

    rebuilt = F.aggregate("all_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                          lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))))
    text = F.when(F.size("all_spans") > 0, rebuilt).otherwise(F.col(at[text_col]))
    return found.select(*[(text if c == at[text_col] else F.col(c)).alias(n) for c, n in zip(plain.columns, names)])
