"""WARC 1.0 archives: written by Spark's text sink, read back by boundary-chain verification.

Writing. Every row becomes one record. Among rows with equal payloads of at least
``min_revisit`` bytes, that with the largest id is a ``response``, the others are ``revisit``
records that refer to it; smaller payloads are all responses. A record is one line of the text
sink, whose line separator is the two line ends that close a WARC record, so any store that
Spark writes to will do and a lost task is written again by the commit protocol.

Reading. The magic ``WARC/1.0`` may also stand inside a payload, so an archive that is read in
byte ranges has no certain record start but its first byte.

1. A task per byte range finds each candidate (the magic) and, from its Content-Length, the
   offset of its successor. It follows these links within the range at once, which leaves one
   link per candidate: to the first offset at or beyond the range's end.
2. Pointer jumping over the links between ranges, from each file's first byte: in every round
   all links double their reach, and what a reached entry points to is reached. After log2(ranges
   of the largest file) rounds the entries are known that lie on the chain of true records.
3. A task per range walks the chain from its verified entry and reads each record, digesting
   payloads in steps of bounded size. Magic inside payloads is never on the chain.

Defined cases: null payload: empty; null url: no target header; null id: no id header, and null
again on reading; rows repeated with the same id and payload are each written, and share their
role; an empty table gives no records; further columns are ignored. A file that does not start
with a record, or a damaged header, ends the chain there.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, written

MAGIC = b"WARC/1.0\r\n"
MIN_REVISIT = 1000
RANGE_BYTES = 16 << 20
_STEP = 1 << 20  # bytes of a payload digested at a time
_HEADER = 1 << 16  # bytes read for a header at first; doubled as long as its end is missing
DATE = "2024-01-01T00:00:00Z"
RECORD = ("file string, offset long, record_type string, record_id long, url string, refers_to long, "
          "payload_bytes long, payload_digest string, claimed_digest string")


def records(rows: DataFrame, id_col: str, url_col: str, payload_col: str,
            min_revisit: int = MIN_REVISIT) -> DataFrame:
    """One WARC record per row, as text in column ``value`` (without the closing line ends)."""
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                       F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    base = base.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    large = F.octet_length("payload") >= min_revisit
    groups = (base.filter(large).groupBy("digest").agg(F.max("id").alias("kept"), F.min("id").alias("least"))
              .filter("least < kept").select(F.col("digest").alias("group"), "kept"))
    groups = written(groups, "equal-payloads")  # its size is known then: payloads are shuffled only if it is large
    revisit = F.coalesce(F.col("id") < F.col("kept"), F.lit(False))
    out = base.join(groups, large & (F.col("digest") == F.col("group")), "left")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, F.lit("")).otherwise(F.concat(http, "payload"))

    def line(name, value):
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    def opt(name, value, text=None):
        return F.coalesce(F.when(value.isNotNull(), line(name, text if text is not None else value)), F.lit(""))

    clean_url = F.regexp_replace("url", r"[\x00-\x20]", "")
    head = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:sha1:"), F.sha1(F.concat_ws(" ", "id", "url", "digest")), F.lit(">"))),
        opt("WARC-Target-URI", clean_url),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        opt("X-Record-Number", F.col("id"), F.col("id").cast("string")),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
            line("X-Refers-To-Number", F.col("kept").cast("string")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"))
    return out.select(F.concat(head, block).alias("value"))


def write(records_df: DataFrame, path: str) -> None:
    """Write the records as uncompressed WARC files below ``path``, one per task."""
    records_df.write.option("lineSep", "\r\n\r\n").text(path)


def _open(uri: str):
    """A seekable file of any store that Arrow knows."""
    from pyarrow import fs
    uri = uri.replace("s3a://", "s3://")
    if re.match(r"file:/(?!/)", uri):
        uri = "file://" + uri[len("file:"):]
    if "://" not in uri:
        return fs.LocalFileSystem().open_input_file(uri)
    from urllib.parse import unquote
    if uri.startswith("file://"):
        return fs.LocalFileSystem().open_input_file(unquote(urlsplit(uri).path))
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


_NAME = re.compile(rb"[A-Za-z0-9!#$%&'*+.^_`|~-]+[ \t]*:")
_REPEATABLE = b"warc-concurrent-to"
_FIELDS = 1000  # of one header at most


def _header(data: bytes, at: int) -> tuple[dict[bytes, bytes], int] | bool | None:
    """(fields in lower case, length of the header) of the record at ``at``; None if it has no end here, False if
    it is no header: a row without a field name, a field that may stand once standing twice, or too many fields.

    Rows are read one by one and the first wrong one ends it, so magic that a payload repeats costs a row each time.
    """
    pos, fields, last = data.find(b"\r\n", at) + 2, {}, b""
    if pos < 2:
        return None
    for _ in range(_FIELDS):
        if data.startswith(b"\r\n", pos):
            return fields, pos + 2 - at
        folded = data[pos: pos + 1] in (b" ", b"\t")
        name = None if folded else _NAME.match(data, pos)
        if not folded and not name:
            # the row may go on behind the data: then what is here of it must be able to begin a field
            rest = data[pos: pos + 256].removesuffix(b"\r")
            return None if data.find(b"\n", pos) < 0 and (not rest or _NAME.fullmatch(rest + b":")) else False
        end = data.find(b"\r\n", pos)
        if end < 0:
            return None
        if folded:
            fields[last] = fields.get(last, b"") + b" " + data[pos:end].strip()
        else:
            last = name[0][:-1].strip().lower()
            if last in fields and last != _REPEATABLE:
                return False
            fields[last] = data[name.end(): end].strip()
        pos = end + 2
    return False


def _record(f, size: int, at: int, data: bytes = b"", base: int = 0):
    """(fields, header length, successor) of a candidate; None if it is none or runs past the file's end."""
    got = _header(data, at - base) if data else None
    span = _HEADER
    while got is None:
        chunk = f.read_at(min(span, size - at), at)
        if not chunk.startswith(MAGIC):
            return None
        got = _header(chunk, 0)
        if got is None and at + span >= size:
            return None
        span *= 2
    if not got:
        return None
    fields, head = got
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or (stop := at + head + int(length) + 4) > size:
        return None
    return fields, head, stop


def archive_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """file, size, start, stop: the byte ranges of all files below ``path`` (contents aren't read)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select(F.col("path").alias("file"), F.col("length").alias("size")).filter("size > 0"))
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))
    ranges = files.select("file", "size", F.explode(starts).alias("start"))
    return ranges.withColumn("stop", F.least(F.col("start") + range_bytes, "size"))


def candidates(ranges: DataFrame) -> DataFrame:
    """file, size, start, stop, offset, successor, leaves: every candidate and where its chain leaves the range."""

    def scan(batches):
        for batch in batches:
            for r in batch.to_pylist():
                start, stop, size = r["start"], r["stop"], r["size"]
                with _open(r["file"]) as f:
                    data = f.read_at(min(stop - start + _HEADER, size - start), start)
                    found, at = [], data.find(MAGIC)
                    while at >= 0 and start + at < stop:
                        if got := _record(f, size, start + at, data, start):
                            found.append((start + at, got[2]))
                        at = data.find(MAGIC, at + 1)
                leaves: dict[int, int] = {}
                for offset, succ in reversed(found):
                    leaves[offset] = leaves.get(succ, succ)
                n = len(found)
                yield pa.RecordBatch.from_pydict({
                    "file": pa.array([r["file"]] * n, pa.string()), "size": pa.array([size] * n, pa.int64()),
                    "start": pa.array([start] * n, pa.int64()), "stop": pa.array([stop] * n, pa.int64()),
                    "offset": pa.array([o for o, _ in found], pa.int64()),
                    "successor": pa.array([s for _, s in found], pa.int64()),
                    "leaves": pa.array([leaves[o] for o, _ in found], pa.int64())})

    return ranges.select("file", "size", "start", "stop").mapInArrow(
        scan, "file string, size long, start long, stop long, offset long, successor long, leaves long")


def verified_entries(found: DataFrame) -> DataFrame:
    """file, size, start, stop, entry: the true record at which the chain enters each range."""
    targets = found.select("file", F.col("leaves").alias("offset")).distinct()
    nodes = (found.join(targets, ["file", "offset"], "left_semi")
             .unionByName(found.filter("offset = 0")).distinct())
    nodes = written(nodes.select("file", "size", "start", "stop", "offset", F.col("leaves").alias("jump"),
                                 (F.col("offset") == 0).alias("reached")), "entries")
    widest = nodes.agg(F.max(F.expr("stop - start")).alias("w"), F.max("size").alias("s")).first()
    ranges = -(-(widest["s"] or 1) // (widest["w"] or 1))
    for _ in range(max(1, int(ranges).bit_length())):
        ahead = nodes.select("file", F.col("offset").alias("jump"), F.col("jump").alias("next"))
        hit = nodes.filter("reached").select("file", F.col("jump").alias("offset"), F.lit(True).alias("hit")).distinct()
        nodes = written(
            nodes.join(ahead, ["file", "jump"], "left").join(hit, ["file", "offset"], "left")
            .select("file", "size", "start", "stop", "offset", F.coalesce("next", "jump").alias("jump"),
                    (F.col("reached") | F.coalesce("hit", F.lit(False))).alias("reached")), "entries")
    return nodes.filter("reached").groupBy("file", "size", "start", "stop").agg(F.min("offset").alias("entry"))


def extract(entries: DataFrame) -> DataFrame:
    """The records of each range, from its verified entry on."""

    def digest(f, at: int, n: int) -> str:
        sha = hashlib.sha1()
        for k in range(at, at + n, _STEP):
            sha.update(f.read_at(min(_STEP, at + n - k), k))
        return sha.hexdigest()

    def number(value):
        return int(value) if value and re.fullmatch(rb"-?\d{1,19}", value) else None

    def walk(batches):
        for batch in batches:
            for r in batch.to_pylist():
                size, rows = r["size"], []
                with _open(r["file"]) as f:
                    base, at = r["entry"], r["entry"]
                    data = f.read_at(min(r["stop"] - base + _HEADER, size - base), base)
                    while at < r["stop"] and data.startswith(MAGIC, at - base):
                        got = _record(f, size, at, data, base)
                        if got is None:
                            break
                        fields, head, succ = got
                        body, n = at + head, succ - 4 - at - head
                        if b"application/http" in fields.get(b"content-type", b"") and n:
                            start = data[body - base: body - base + _HEADER]
                            if len(start) < min(n, _HEADER):
                                start = f.read_at(min(n, _HEADER), body)
                            skip = start[:n].find(b"\r\n\r\n") + 4
                            if skip >= 4:
                                body, n = body + skip, n - skip
                        if body + n <= base + len(data):
                            sha = hashlib.sha1(memoryview(data)[body - base: body - base + n]).hexdigest()
                        else:
                            sha = digest(f, body, n)
                        url = fields.get(b"warc-target-uri")
                        rows.append({
                            "file": r["file"], "offset": at,
                            "record_type": fields.get(b"warc-type", b"").decode("utf-8", "replace"),
                            "record_id": number(fields.get(b"x-record-number")),
                            "url": url.decode("utf-8", "replace") if url is not None else None,
                            "refers_to": number(fields.get(b"x-refers-to-number")),
                            "payload_bytes": n, "payload_digest": sha,
                            "claimed_digest": fields.get(b"warc-payload-digest", b"").decode()
                                                    .removeprefix("sha1:")})
                        at = succ
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    return entries.mapInArrow(walk, RECORD)


def read(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The true records of the archives below ``path``; a revisit has its response's payload figures."""
    ranges = archive_ranges(spark, path, range_bytes)
    spread = ranges.repartition(_tasks(ranges), "file", "start")
    found = written(candidates(spread), "candidates")
    entries = verified_entries(found)
    got = written(extract(entries.repartition(_tasks(ranges), "file", "start")), "records")
    kept = (got.filter("record_type = 'response'").groupBy("record_id", "payload_digest")
            .agg(F.first("payload_bytes").alias("kept_bytes"))
            .select(F.col("record_id").alias("kept_id"), F.col("payload_digest").alias("kept_digest"), "kept_bytes"))
    revisit = F.col("record_type") == "revisit"
    return got.join(kept, revisit & (F.col("refers_to") == F.col("kept_id"))
                    & (F.col("claimed_digest") == F.col("kept_digest")), "left") \
        .select("file", "offset", "record_type", "record_id", "url", "refers_to",
                F.when(revisit, F.col("kept_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
                F.when(revisit, F.col("kept_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"))


def _tasks(ranges: DataFrame) -> int:
    """As many tasks as ranges, within what one stage should have."""
    return int(np.clip(ranges.count(), 1, 20_000))


def round_trip(rows: DataFrame, id_col: str, url_col: str, payload_col: str,
               min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write ``rows`` as archives in the shared folder and read them back."""
    spark = rows.sparkSession
    path = shared_path(spark, "warc")
    write(records(rows, id_col, url_col, payload_col, min_revisit), path)
    return read(spark, path)


_RECORD = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()),
                     ("record_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()),
                     ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("claimed_digest", pa.string())])
