"""Incremental upkeep of the daily call counts: late calls and replays correct closed days.

Each micro-batch writes the counts of its own calls per (user, day) below its batch id; a replayed batch
replaces what it wrote before. The daily count is the sum over all batches, so a call that arrives
after its day has ended, however late, is in the sum as soon as its batch is written, and no
streaming state is kept. ``compact`` sums finished batches into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import usage

_DELTAS = "user_id bigint, day timestamp_ntz, used bigint, generation int, batch_id bigint"


def deltas(calls: DataFrame, exclude: str | None = None) -> DataFrame:
    """user_id, day, used of one batch of logged requests."""
    return usage.usage_daily(calls, exclude=exclude).select("user_id", "day", "used")


def start_usage_upkeep(requests: DataFrame, path: str, checkpoint: str, exclude: str | None = None,
                       available_now: bool = False) -> StreamingQuery:
    """Keep the deltas below ``path`` up to date with a stream of logged requests."""

    def write(batch: DataFrame, batch_id: int) -> None:
        deltas(batch, exclude).write.mode("overwrite").parquet(f"{path}/generation=0/batch_id={batch_id}")

    w = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def _live(spark: SparkSession, path: str) -> DataFrame:
    """The deltas that count: those of batches behind the last compaction, and that compaction.

    A compaction is generation 1 under the number of its last batch.
    """
    rows = spark.read.schema(_DELTAS).option("basePath", path).parquet(path)
    done = rows.where("generation = 1").agg(F.max("batch_id").alias("done")).select(F.coalesce("done", F.lit(-1)).alias("done"))
    done = done.scalar()
    return rows.where(((F.col("generation") == 1) & (F.col("batch_id") == done))
                      | ((F.col("generation") == 0) & (F.col("batch_id") > done)))


def daily_totals(spark: SparkSession, path: str, limit: int = usage.DAILY_LIMIT) -> DataFrame:
    """user_id, day, used and quota over all batches written so far."""
    total = _live(spark, path).groupBy("user_id", "day").agg(F.sum("used").cast("bigint").alias("used"))
    return total.select("user_id", "day", "used", *usage.quota(F.col("used"), limit))


def compact(spark: SparkSession, path: str, through: int) -> None:
    """Sum the batches up to ``through`` (all finished) into one, which replaces them in the totals."""
    rows = _live(spark, path).where(F.col("batch_id") <= through)
    (rows.groupBy("user_id", "day").agg(F.sum("used").cast("bigint").alias("used"))
     .write.mode("overwrite").parquet(f"{path}/generation=1/batch_id={through}"))
