"""Session construction for tests and the benchmark, and lineage cutting.

Library functions never create sessions; they take DataFrames. This module is
the only place that sets configuration, and it only fills settings that are
unset, so a cluster's own settings (checkpoint dir, partitions) always win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings a production job wants; applied with setIfMissing semantics.
_SCALE_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "jobledger") -> SparkSession:
    """Local session for tests / bench. A running session is returned with its own settings."""
    running = SparkSession.getActiveSession()
    if running is not None:  # its settings stay as they are
        ensure_checkpoint_dir(running)
        return running
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app_name)
    wanted = {**_SCALE_DEFAULTS, "spark.master": master or f"local[{cpus}]",
              "spark.sql.shuffle.partitions": str(shuffle_partitions or int(cpus)),
              "spark.driver.memory": os.environ.get("SPARK_DRIVER_MEMORY", "8g")}
    for k, v in wanted.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def json_semantics(spark: SparkSession) -> None:
    """Of duplicate JSON object keys the last wins (Spark's parser refuses such texts otherwise)."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a scratch one only where unset in local mode (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the checkpoint dir
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="jobledger-ckpt-"))  # driver and executors are one process
    else:
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint dir (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
