"""Boilerplate removal by site-relative line frequency.

A line is boilerplate on a host if the share of the host's pages that hold it exceeds ``ratio``
and at least ``min_pages`` pages do (on a host of two pages half of all lines would be
boilerplate otherwise). Pages of one host with the same text count as one page, here and in the
total: copies of a page don't make its own lines boilerplate. Lines are compared without outer white space; empty ones are kept as
they are and never counted.

DataFrame functions only. A page's distinct lines are digested (128 bits) before they are
exploded, so text isn't shuffled to be counted; counts per (host, line) are summed by each task
first, so a host with a third of all pages is spread over its lines, and a line with most of its
pages is one row per task. Pages meet the boilerplate of their host in an equi-join that the
planner broadcasts or splits by size; only the dropped digests per page are joined back to texts.

Defined cases: a text of any length is handled whole, line by line; null or empty host: one common host; null text stays null and counts as a page
without lines; rows with null or repeated ids are pages of their own, matched by id and
text; a text whose lines are all dropped becomes empty; an empty table gives an empty result;
further columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATIO = 0.05
MIN_PAGES = 5
#: White space cut from both ends of a line before it is compared.
BLANKS = " \t\r\x0b\x0c"


def _digest(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _digests(text: Column) -> Column:
    """Distinct digests of the lines that aren't blank."""
    trimmed = F.filter(F.transform(_lines(text), _trimmed), lambda x: x != "")
    return F.array_distinct(F.transform(trimmed, _digest))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO,
                min_pages: int = MIN_PAGES) -> DataFrame:
    """host, line (digest), pages, share: the lines to drop."""
    body = F.col(text).cast("string")
    named = pages.select(_host(host).alias("host"), _digest(F.coalesce(body, F.lit(""))).alias("page"),
                         _digests(body).alias("lines"))
    totals = (named.select("host", "page").distinct()
              .groupBy("host").agg(F.count(F.lit(1)).alias("total")))
    counts = (named.groupBy("host", "page").agg(F.first("lines").alias("lines"))
              .select("host", F.explode("lines").alias("line"))
              .groupBy("host", "line.a", "line.b").agg(F.count(F.lit(1)).alias("pages"))
              .filter(F.col("pages") >= min_pages))
    return (counts.join(totals, "host").filter(F.col("pages") > ratio * F.col("total"))
            .select("host", F.struct("a", "b").alias("line"), "pages", (F.col("pages") / F.col("total")).alias("share")))


def _host(host: str) -> Column:
    return F.coalesce(F.col(host).cast("string"), F.lit(""))


def dedup(pages: DataFrame, id_col: str = "doc_id", host: str = "source", text: str = "text",
          ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with the boilerplate lines cut from ``text``, and ``n_dropped`` (lines cut)."""
    names = pages.columns
    at = {c: f"c{names.index(c)}" for c in (id_col, host, text)}
    plain = pages.toDF(*[f"c{i}" for i in range(len(names))])
    drop = boilerplate(plain, at[host], at[text], ratio, min_pages).select("host", "line")
    body = F.col(at[text]).cast("string")
    key = [F.col(at[id_col]).alias("page"), F.xxhash64(body).alias("text_key")]
    hits = (plain.select(*key, _host(at[host]).alias("host"), F.explode(_digests(body)).alias("line"))
            .join(drop, ["host", "line"]).groupBy("page", "text_key", "host")
            .agg(F.collect_set("line").alias("dropped"))
            .select(F.col("page").alias("k_page"), F.col("text_key").alias("k_text"), F.col("host").alias("k_host"), "dropped"))
    joined = plain.withColumn("text_key", F.xxhash64(body)).join(
        hits, (F.col(at[id_col]).eqNullSafe(F.col("k_page"))) & (F.col("text_key") == F.col("k_text"))
        & (_host(at[host]) == F.col("k_host")), "left")
    kept = F.filter(_lines(body), lambda x: (_trimmed(x) == "") | ~F.array_contains("dropped", _digest(_trimmed(x))))
    staged = joined.withColumn("kept", F.when(F.col("dropped").isNotNull(), kept))
    cut = F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n")).otherwise(body)
    n_dropped = F.when(F.col("kept").isNotNull(), F.size(_lines(body)) - F.size("kept")).otherwise(0)
    columns = [cut if c == at[text] else F.col(c) for c in plain.columns]
    return staged.select(*[c.alias(n) for c, n in zip(columns, names)], n_dropped.cast("long").alias("n_dropped"))
