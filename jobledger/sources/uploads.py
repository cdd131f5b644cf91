"""Upload gate (S4) re-aimed at bulk files: PDF only, at most 5 MiB."""

from __future__ import annotations

import itertools
import os
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
MAX_UPLOAD_BYTES = 5 * 1024 * 1024
PDF_MAGIC = "%PDF-"
WRITE_SHARDS = 64  # tasks that write files, and folders that they are listed by
# ---------------------------------------------------------------------------


def upload_gate(spark: SparkSession, directory: str) -> DataFrame:
    """(path, length, reject_code): null code = accepted.

    The folder is listed once. Size comes from the listing (``_metadata.file_size``), so oversize files are
    rejected without being opened; the content of the others is scanned for the PDF signature.
    Files of no bytes are left out by Spark's reader and give no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    size = F.col("_metadata.file_size")
    large = files.where(size > MAX_UPLOAD_BYTES).select(
        "path", "length", F.lit("FILE_TOO_LARGE").alias("reject_code"))
    signed = F.substring(F.col("content"), 1, len(PDF_MAGIC)) == F.lit(PDF_MAGIC.encode())
    is_pdf = F.lower(F.col("path")).endswith(".pdf") & signed
    small = files.where(size <= MAX_UPLOAD_BYTES).select(
        "path", "length", F.when(~F.coalesce(is_pdf, F.lit(False)), F.lit("INVALID_FILE_TYPE")).alias("reject_code"))
    return large.unionByName(small)


def write_uploads(files: DataFrame, key: str, folder: str) -> None:
    """Writes (key, extension, body, size) as a file per key and extension; ``key=<key>`` stands in its path.

    A body is filled with blanks up to ``size`` bytes and closed by a line end; an empty one stays a file of no bytes.
    Rows of one key and extension follow each other in its file; null keys are left out. Hadoop's local file system starts a process for every file, folder and
    checksum that it makes, so tasks write there themselves (files are hidden until complete); other stores get Spark's writer.
    """
    rows = files.where(F.col(key).isNotNull()).select(
        F.pmod(F.hash(key), F.lit(WRITE_SHARDS)).alias("shard"), key, "extension",
        F.coalesce("body", F.lit("")).alias("body"), "size")
    rows = rows.repartition(WRITE_SHARDS, key).sortWithinPartitions("shard", key, "extension")
    if folder.startswith("file:"):
        rows.mapInArrow(_local_writer(key, re.sub("^file:/*", "/", folder)), "files long").agg(F.sum("files")).first()
    else:
        _write_by_spark(rows, key, folder)


def _local_writer(key: str, folder: str):
    def write(batches):
        pieces = (batch.slice(i, 100) for batch in batches for i in range(0, batch.num_rows, 100))
        rows = (row for piece in pieces for row in zip(*(c.to_pylist() for c in piece.columns)))
        n = 0
        for (shard, k, extension), same in itertools.groupby(rows, lambda r: r[:3]):
            place = os.path.join(folder, f"shard={shard}")
            os.makedirs(place, exist_ok=True)
            hidden = os.path.join(place, f".{uuid.uuid4().hex}")
            with open(hidden, "wb") as f:
                f.writelines(body.encode().ljust(size) + b"\n" for _, _, _, body, size in same if body or size)
            os.replace(hidden, os.path.join(place, f"{key}={k}.{extension}"))
            n += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})
    return write


def _write_by_spark(rows: DataFrame, key: str, folder: str) -> None:
    """A folder per file, as Spark names the files themselves. Its writer takes a line a row: line ends become blanks."""
    gap = F.greatest(F.lit(0), F.col("size") - F.octet_length("body")).cast("int")
    lines = rows.withColumn("body", F.concat(F.translate("body", "\r\n", "  "), F.repeat(F.lit(" "), gap)))
    for extension in sorted(r[0] for r in rows.select("extension").distinct().collect()):
        (lines.where(F.col("extension") == extension).select("shard", key, "body").write.partitionBy("shard", key)
         .option("extension", extension).option("quote", "").option("sep", "\x01")
         .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
         .option("emptyValue", "").option("escape", "").csv(f"{folder.rstrip('/')}/{extension}"))
