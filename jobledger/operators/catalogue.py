"""Catalogue filter (F14, O2): entries whose name holds a part and which list a capability,
defaults for missing fields, sorted by name; plus a 'preferred' subset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NA = "N/A"


def catalogue(entries: DataFrame, name_part: str, capability: str) -> DataFrame:
    """name contains ``name_part`` and ``capabilities`` contains ``capability``; N/A defaults."""
    hit = entries.where(F.col("name").contains(name_part) & F.array_contains("capabilities", capability))
    out = hit.select(
        "name",
        F.coalesce(F.nullif("display_name", F.lit("")), F.lit(NA)).alias("display_name"),
        F.coalesce(F.nullif("description", F.lit("")), F.lit(NA)).alias("description"),
        F.coalesce(F.col("input_limit").cast("string"), F.lit(NA)).alias("input_limit"),
        F.coalesce(F.col("output_limit").cast("string"), F.lit(NA)).alias("output_limit"),
        F.array_join("capabilities", ", ").alias("methods"))
    return out.orderBy(F.collate("name", "UNICODE"), "name")  # as a locale orders it: letters first, then case


def preferred(entries: DataFrame, must: str, any_of: Sequence[str]) -> DataFrame:
    """Subset whose name contains ``must`` and at least one of ``any_of``."""
    anyc = F.lit(False)
    for a in any_of:
        anyc = anyc | F.col("name").contains(a)
    return entries.where(F.col("name").contains(must) & anyc)
