"""Sinks: contacts CSV / JSON export (S5, S6) and the audit append (S7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.audit import audit_record
from ..operators.contacts import CSV_COMPANY_THRESHOLD, CSV_HEADERS


def _named(wide: DataFrame, joined: bool = True) -> DataFrame:
    cols = ["company", "website", "company_linkedin_url", "hr_linkedin_url", "hr_links", "hr_first_name",
            "hr_last_name"]
    out = wide.withColumn("hr_links", F.array_join("hr_links", "; ")) if joined else wide
    return out.select(*[F.col(c).alias(h) for c, h in zip(cols, CSV_HEADERS)])


def write_contacts_csv(wide: DataFrame, path: str) -> None:
    """Seven fixed headers; quote only when needed, doubling quotes; null -> empty."""
    (_named(wide).write.mode("overwrite")
     .option("header", True).option("quote", '"').option("escape", '"')
     .option("nullValue", "").option("emptyValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def write_contacts_json(wide: DataFrame, path: str) -> None:
    """JSON rows: links stay an array, nulls are written."""
    _named(wide, joined=False).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_contacts(wide: DataFrame, path: str, fmt: str) -> None:
    """``fmt`` csv or json; the service chooses per request (see ``format_for``)."""
    {"csv": write_contacts_csv, "json": write_contacts_json}[fmt](wide, path)


def format_for(companies: Column) -> Column:
    """The service's choice for a request, from its array of companies: csv for more than five."""
    return F.when(F.size(companies) > CSV_COMPANY_THRESHOLD, F.lit("csv")).otherwise(F.lit("json"))


def append_audit(records: DataFrame, path: str, batch: str, enriched: bool = False) -> None:
    """Append redacted audit rows, partitioned by day and batch.

    A batch that is written again replaces its own partitions, so a retry doubles nothing. A
    failed write raises. ``enriched``: the rows are audit records already.
    """
    out = records if enriched else audit_record(records)
    out = out.drop("user_email").withColumn("day", F.to_date("created_at")).withColumn("batch_id", F.lit(batch))
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day", "batch_id").parquet(path))
