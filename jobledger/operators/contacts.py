"""Company contact lookup: search strings, top-k links, one wide row per company, CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_cell, js_trim, name_from_slug, search_string
from .common import top_k_per_group

# --- fixed values -----------------------------------------------------------
QUERY_KINDS = ("linkedin", "website", "hr_linkedin")
LINKS_PER_KIND = {"linkedin": 1, "website": 1, "hr_linkedin": 3}
CSV_HEADERS = ("Company Name", "Website", "Company LinkedIn URL", "HR LinkedIn URL", "HR LinkedIn URLs",
               "HR First Name", "HR Last Name")
CSV_COMPANY_THRESHOLD = 5
REJECT_NO_COMPANIES = "No companies provided. Please provide at least one company name."
# ---------------------------------------------------------------------------


def clamp_k(k: Column) -> Column:
    return F.least(F.greatest(F.coalesce(k, F.lit(1)), F.lit(1)), F.lit(10))


def clean_companies(arr: Column) -> Column:
    """Keep strings, trim, drop empty."""
    return F.filter(F.transform(arr, lambda x: js_trim(x)), lambda x: x.isNotNull() & (x != ""))


def search_requests(requests: DataFrame, kinds=QUERY_KINDS) -> DataFrame:
    """One search string per (request, kind); an unknown kind yields null."""
    r = requests.select("*", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"))
    return r.withColumn("query", search_string(F.col("company"), F.col("kind"), F.col("location")))


def contact_links(hits: DataFrame, per_kind: dict = LINKS_PER_KIND) -> DataFrame:
    """Top-k non-empty links per (company, kind) by search rank."""
    k_map = F.create_map(*[x for kind, k in per_kind.items() for x in (F.lit(kind), F.lit(k))])
    k = clamp_k(F.try_element_at(k_map, F.col("kind")))
    live = hits.where(F.col("link").isNotNull() & (F.col("link") != ""))
    return top_k_per_group(live, ["company", "kind"], [F.col("rank"), F.col("hit_id")],
                           max(per_kind.values()), k, rank_col="rn")


def contacts_wide(links: DataFrame, companies: DataFrame) -> DataFrame:
    """One row per company: first website / company page / HR profile, all HR links, HR name."""
    def first_of(kind):
        return F.max(F.when((F.col("kind") == kind) & (F.col("rn") == 1), F.col("link")))
    hr = F.array_sort(F.collect_list(F.when(F.col("kind") == "hr_linkedin", F.struct("rn", "link"))))
    agg = links.groupBy("company").agg(
        first_of("website").alias("website"), first_of("linkedin").alias("company_linkedin_url"),
        first_of("hr_linkedin").alias("hr_linkedin_url"),
        F.transform(hr, lambda s: s["link"]).alias("hr_links"))
    out = companies.select("company").distinct().join(agg, "company", "left")
    nm = name_from_slug(F.col("hr_linkedin_url"))
    return out.select("company", "website", "company_linkedin_url", "hr_linkedin_url",
                      F.coalesce(F.col("hr_links"), F.array().cast("array<string>")).alias("hr_links"),
                      nm["first_name"].alias("hr_first_name"), nm["last_name"].alias("hr_last_name"))


def csv_line(wide: DataFrame) -> Column:
    cells = [F.col("company"), F.col("website"), F.col("company_linkedin_url"), F.col("hr_linkedin_url"),
             F.array_join(F.col("hr_links"), "; "), F.col("hr_first_name"), F.col("hr_last_name")]
    return F.concat_ws(",", *[csv_cell(c) for c in cells])


def csv_header() -> str:
    return ",".join(CSV_HEADERS)
