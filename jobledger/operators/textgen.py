"""Text-generation batches: prompt rows before the model step, parsing and metrics after it.

The model call itself is outside Spark (an external service); job 1 writes a
prompt table, job 2 reads replies and parses / measures them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompt_texts as P
from ..functions.jsonx import check_shape, extract_json_columns
from ..functions.text import text_stats


def _round_half_up(num: Column, den: Column, scale: int) -> Column:
    """round(num/den, scale) half-up on the exact ratio of two integers (engine independent)."""
    m = 10 ** scale
    q = F.floor((num.cast("double") * (2 * m) + den.cast("double")) / (den.cast("double") * 2))
    return F.when(den != 0, q / F.lit(float(m)))


def _json_array(arr: Column) -> Column:
    return F.to_json(arr)


def prompt(kind: str, **cols: Column) -> Column:
    """Prompt text per request kind, exactly as the service assembles it."""
    if kind == "keywords":
        return F.concat(F.lit(P.KEYWORDS_SYSTEM + "\n Job Description:\n"), cols["job_description"],
                        F.lit("\n\nCurrent Skills:\n"), _json_array(cols["skills"]),
                        F.lit("\n\nResponse Format:" + P.KEYWORDS_SCHEMA))
    if kind == "coverletter":
        return F.concat(F.lit(P.COVERLETTER_SYSTEM + "\n Job Description:\n"), cols["job_description"],
                        F.lit("\n\nresume:\n"), cols["resume_json"],
                        F.lit("\n\nResponse Format:" + P.COVERLETTER_SCHEMA))
    if kind == "experience":
        return F.concat(F.lit(P.EXPERIENCE_SYSTEM + "\n Job Description:\n"), cols["job_description"],
                        F.lit("\n Experience:\n"), cols["experience_json"],
                        F.lit("\nResponse Format:" + P.EXPERIENCE_SCHEMA))
    if kind == "upload_resume":
        return F.concat(F.lit(P.RESUME_SYSTEM + "\n Candidate resume: "), cols["resume_text"],
                        F.lit("\n Experience Schema: " + P.EXPERIENCE_SCHEMA
                              + " and arrange all information in this format Resume Schema: " + P.RESUME_SCHEMA))
    if kind == "chat":
        return F.concat(F.lit(P.CHAT_SYSTEM + "\n\nJob Description:\n"), cols["job_description"],
                        F.lit("\n\nCandidate Resume (JSON):\n"), cols["resume"],
                        F.lit("\n\nUser Question:\n"), cols["question"])
    raise ValueError(f"unknown prompt kind {kind!r}")


# --- fixed values -----------------------------------------------------------
# Validation message per request kind when a required field is missing.
REQUIRED_MESSAGES = {
    "chat": "Missing required fields: question, jobDescription, and resume are required",
    "coverletter": "Missing required fields: jobDescription and resume are required",
    "experience": "Missing required fields: jobDescription and experience are required",
    "keywords": "Missing required fields: jobDescription and skills are required",
    "upload_resume": "Empty resume text. Please provide valid resume content.",
}
NO_RESUME_MESSAGE = "No resume provided. Please provide resumeText."
# ---------------------------------------------------------------------------


def _with_stats(staged: DataFrame, keys: list[str]) -> DataFrame:
    """Status, reason, prompt and its statistics; the prompt is a column of its own, so it is made once."""
    st = text_stats(F.col("prompt"))
    ok = F.col("prompt").isNotNull()
    return staged.select(*keys, F.when(ok, "ok").otherwise("rejected").alias("status"), "reject_reason", "prompt",
                         F.when(ok, st["chars"]).alias("chars"), F.when(ok, st["words"]).alias("words"),
                         F.when(ok, st["est_tokens"]).alias("est_tokens"))


def keyword_prompts(postings: DataFrame, skills: DataFrame) -> DataFrame:
    """Keyword-comparison prompts: one per posting whose candidate sent a skills list.

    ``skills`` is long (owner_id, pos, skill). A list is one request's body, so it is regrouped
    per request; a request too large for the service never became a row.
    """
    lists = skills.groupBy("owner_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "skill"))), lambda s: s["skill"]).alias("skills"))
    j = postings.join(lists, postings.doc_id == lists.owner_id, "left").drop("owner_id")
    ok = F.col("text").isNotNull() & (F.col("text") != "") & F.col("skills").isNotNull()
    return _with_stats(j.select(
        "doc_id", F.when(ok, prompt("keywords", job_description=F.col("text"), skills=F.col("skills"))).alias("prompt"),
        F.when(~ok, F.lit(REQUIRED_MESSAGES["keywords"])).alias("reject_reason")), ["doc_id"])


def build_prompts(requests: DataFrame, kind: str, keys: list[str], required: dict[str, Column],
                  inputs: dict[str, Column], missing_first: Column | None = None) -> DataFrame:
    """Prompt rows for one request kind: ``status`` is ``rejected`` (with the service's
    validation message) when a required field is missing (falsy), else ``ok`` with the
    prompt text and its size stats. ``missing_first``: a condition checked before the
    others, with its own message (resume upload: no text at all)."""
    ok = F.lit(True)
    for c in required.values():
        ok = ok & c.isNotNull() & (c.cast("string") != "")
    reason = F.when(ok, F.lit(None).cast("string"))
    if missing_first is not None:
        reason = reason.when(missing_first, F.lit(NO_RESUME_MESSAGE))
    reason = reason.otherwise(F.lit(REQUIRED_MESSAGES[kind]))
    return _with_stats(requests.select(*keys, F.when(ok, prompt(kind, **inputs)).alias("prompt"),
                                       reason.alias("reject_reason")), keys)


def call_metrics(calls: DataFrame) -> DataFrame:
    """Per call: input share % (of in and out), tokens/s of the reported total, in and out; null when unknown or ms = 0.

    A total of 0 counts as not reported.
    """
    i, o, ms = F.col("in_tokens"), F.col("out_tokens"), F.col("ms")
    known = i.isNotNull() & o.isNotNull()
    tot = i + o
    reported = F.col("total_tokens")
    return calls.select(
        "id", "service",
        F.when(known & (tot > 0), _round_half_up(i * 100, tot, 1)).alias("input_share_pct"),
        F.when((reported > 0) & (ms > 0), _round_half_up(reported * 1000, ms, 2)).alias("tokens_per_sec"),
        F.when(i.isNotNull() & (ms > 0), _round_half_up(i * 1000, ms, 2)).alias("in_tokens_per_sec"),
        F.when(o.isNotNull() & (ms > 0), _round_half_up(o * 1000, ms, 2)).alias("out_tokens_per_sec"))


def token_metrics(calls: DataFrame) -> DataFrame:
    """Per service roll-up: token sums over calls whose usage is known, throughput over those with a reported total."""
    known = F.col("in_tokens").isNotNull() & F.col("out_tokens").isNotNull()
    reported = F.col("total_tokens") > 0
    g = calls.groupBy("service").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count(F.when(known, 1)).alias("known_calls"),
        F.sum(F.when(known, F.col("in_tokens"))).alias("in_tokens"),
        F.sum(F.when(known, F.col("out_tokens"))).alias("out_tokens"),
        F.sum(F.when(known, F.col("ms"))).alias("known_ms"),
        F.sum(F.when(reported, F.col("total_tokens"))).alias("total_tokens"),
        F.sum(F.when(reported, F.col("ms"))).alias("_reported_ms"),
        F.sum("ms").alias("total_ms"))
    tot = F.col("in_tokens") + F.col("out_tokens")
    ms = F.col("_reported_ms")
    return g.select("*",
                    F.when(tot > 0, _round_half_up(F.col("in_tokens") * 100, tot, 1)).alias("input_share_pct"),
                    F.when(ms > 0, _round_half_up(F.col("total_tokens") * 1000, ms, 2)).alias("tokens_per_sec")
                    ).drop("_reported_ms")


def stage_share(parts: DataFrame, part_col: str, key_col: str) -> DataFrame:
    """Share (%) of each part in the total. The total is a scalar subquery (one
    aggregate, computed once), so no task has to see all parts together."""
    total = parts.select(F.sum(F.col(part_col))).scalar()
    return parts.select(key_col, part_col, total.cast("bigint").alias("total"),
                        _round_half_up(F.col(part_col) * 100, total, 1).alias("share_pct"))


def parse_replies(calls: DataFrame, lenient: bool = False) -> DataFrame:
    return extract_json_columns(calls.select("id", "response_text"), "response_text", lenient).select(
        "id", "status", "payload")


def reply_shapes(replies: DataFrame) -> DataFrame:
    return replies.select("id", *[check_shape(F.col("payload"), k).alias(f"{k}_ok")
                                  for k in ("keywords", "experience", "resume", "coverletter")])
