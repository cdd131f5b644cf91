"""Shared helpers: intermediate tables in the cluster's shared folder, word caches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import blake2b

from pyspark.sql import DataFrame, SparkSession

from jobledger.session import ensure_checkpoint_dir

#: Entries a worker's word cache may hold before it starts afresh (bounds memory, never results).
CACHE_WORDS = 300_000


_SCRATCH: list[str] = []  # folders of the open ``scratch`` blocks of this driver


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared checkpoint folder, or below that of ``scratch``."""
    base = _SCRATCH[-1] if _SCRATCH else ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables written inside lie in one folder, which is deleted at the end.

    Results are lazy and may read those tables, so write them elsewhere before leaving.
    """
    folder = shared_path(spark, "scratch")
    _SCRATCH.append(folder)
    try:
        yield folder
    finally:
        _SCRATCH.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives the planner exact sizes.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_for(df: DataFrame) -> int:
    """Shuffle partitions of the session, for an explicit repartition."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


#: bytes.translate table: A-Z in lower case; of the other ASCII only digits and a-z stay, the rest are blanks.
#: Bytes of longer UTF-8 characters stay, so splitting at blanks gives the words of a UTF-8 text.
WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256))


class WordHashes(dict):
    """bytes -> 64-bit hash of a word, computed once per distinct word.

    ``trim()`` between documents keeps the cache bounded; hashes never depend on it.
    """

    def __missing__(self, word: bytes) -> int:
        h = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return h

    def trim(self) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()
