"""A stored table that takes change batches: versions, atomic commits, partial rewrites.

The rows lie in Parquet folders by a hash bucket of the key. A version is one small manifest file that
names, for every bucket, the folder that holds it. A change batch reads and rewrites only the buckets
its keys fall into, into a new folder, and its manifest takes the others over as they are; every earlier
version stays readable. A commit is the renaming of the finished manifest to the next version's name, which
fails if that name exists, so of two writers from the same version one is refused.

The files of a bucket may be many: a bucket that holds a hot key is written by several tasks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "bucket"


class CommitConflict(RuntimeError):
    """Another writer has committed the version that this one wanted to."""


class VersionedTable:
    """``path`` in storage that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- manifests
    def _hadoop_path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, path: str) -> list[str]:
        at = self._hadoop_path(path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self._names(f"{self.path}/manifests") if n[0].isdigit())

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/manifests/{version:012d}.json"

    def manifest(self, version: int | None = None) -> dict:
        """key, buckets, schema, and ``folders``: bucket -> folder of its rows (none for an empty bucket)."""
        version = self.versions()[-1] if version is None else version
        return json.loads(self.spark.read.text(self._manifest_path(version), wholetext=True).first()[0])

    def _commit(self, version: int, manifest: dict) -> None:
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._hadoop_path(self.path).toUri(), self.spark._jsc.hadoopConfiguration())
        to = self._hadoop_path(self._manifest_path(version))
        own = self._hadoop_path(f"{self.path}/manifests/_{uuid.uuid4().hex}")
        out = own.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(own, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        options = self.spark._jvm.java.lang.reflect.Array.newInstance(
            self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(own, to, options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            context.delete(own, False)
            raise CommitConflict(f"version {version} of {self.path} exists") from e

    # --- rows
    def _bucket(self, key: list[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, key: list[str], buckets: int) -> dict[str, str]:
        """Write rows to a new folder; bucket -> its part of it."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        (rows.withColumn(BUCKET, self._bucket(key, buckets)).hint("rebalance", BUCKET)
         .write.partitionBy(BUCKET).parquet(folder))
        return {n.split("=")[1]: f"{folder}/{n}" for n in self._names(folder) if n.startswith(f"{BUCKET}=")}

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: list[str], buckets: int) -> VersionedTable:
        """Version 0. ``key`` decides the bucket: change batches must name it."""
        table = cls(rows.sparkSession, path)
        folders = table._write(rows, key, buckets)
        schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
        table._commit(0, {"key": key, "buckets": buckets, "schema": schema, "folders": folders})
        return table

    def _rows(self, manifest: dict, folders: list[str]) -> DataFrame:
        reader = self.spark.read.schema(manifest["schema"])
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], manifest["schema"])

    def read(self, version: int | None = None) -> DataFrame:
        manifest = self.manifest(version)
        return self._rows(manifest, sorted(manifest["folders"].values()))

    def apply(self, changes: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame],
              version: int | None = None) -> int:
        """Commit ``change(rows, changes)`` as the next version of ``version`` (default: the last); returns its number.

        ``change`` gets only the rows of buckets that the changes' keys fall into, and must not move a row
        to another key. Raises ``CommitConflict``, and changes nothing, if that version has a successor already.
        """
        version = self.versions()[-1] if version is None else version
        manifest = self.manifest(version)
        key, buckets, folders = manifest["key"], manifest["buckets"], dict(manifest["folders"])
        touched = [str(r[0]) for r in changes.select(self._bucket(key, buckets)).distinct().collect()]  # <= buckets
        rows = self._rows(manifest, sorted(folders[b] for b in touched if b in folders))
        columns = [F.col(f"`{c}`") for c in rows.columns]
        written = self._write(change(rows, changes).select(*columns), key, buckets)
        if not set(written) <= set(touched):
            raise ValueError("the change moved rows to other buckets")
        for b in touched:
            folders.pop(b, None)
        self._commit(version + 1, {**manifest, "folders": {**folders, **written}})
        return version + 1
