"""Skill dictionary sources (S2 line file, S3 category JSON) -> (norm, name)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skills import build_dict


def read_skill_lines(spark: SparkSession, path: str) -> DataFrame:
    """One skill per line; blank and ``#`` lines dropped; the last line wins on equal normal form.

    Files count in the order of their paths, lines in the order of their file: a line's place is
    its file's path, the start of the block it was read in, and its number among the rows of the task that
    read the block, which grows with every line.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("row"))
    return build_dict(spark.read.text(path).select(place.alias("pos"), F.col("value").alias("name")))


def read_skill_json(spark: SparkSession, path: str) -> DataFrame:
    """``{category: [skill, ...]}``; categories dropped; later entries win, files in the order of their paths.

    A dictionary document is a single JSON value (tens of thousands of names), so each file is
    read whole; the flattening is a generator, not a driver loop.
    """
    doc = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.from_json("value", "map<string,array<string>>").alias("m"))
    cats = doc.select("file", F.posexplode(F.map_values("m")).alias("ci", "skills"))
    names = cats.select("file", "ci", F.posexplode("skills").alias("si", "name"))
    return build_dict(names.select(F.struct("file", "ci", "si").alias("pos"), "name"), is_lines=False)
