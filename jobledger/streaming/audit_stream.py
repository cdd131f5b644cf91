"""Structured Streaming forms of the request-log rules (same Column functions as batch).

ST1 ``start_audit_stream``: enrich each micro-batch, append it to the audit
table (by day, as the batch sink does) and the alert table. Writes are idempotent
per micro-batch: each batch overwrites its own ``batch_id`` directories, so a replay
after a failure rewrites instead of duplicating.

ST2 ``quota_stream``: per-user daily counts on a 1-day tumbling event-time
window with a watermark. Lateness rule (ours; the source service has none): a
call arriving later than the watermark delay after its day ended is dropped
from the streaming count; the batch ``usage_daily`` over the stored table
remains the exact answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import audit, usage
from ..sources.export import append_audit


def enrich(requests: DataFrame) -> DataFrame:
    """Streaming or batch: the audit record with redacted bodies, plus a day column."""
    return audit.audit_record(requests).withColumn("day", F.to_date("created_at"))


def _write_batch(table_path: str, alerts_path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            append_audit(batch, table_path, f"stream-{batch_id}", enriched=True)
            (audit.alert_rows(batch)
             .select("id", "service", "status_code", "error_code", "error_message", "user_id", "path")
             .write.mode("overwrite").parquet(f"{alerts_path}/batch_id={batch_id}"))
        finally:
            batch.unpersist()
    return write


def start_audit_stream(requests: DataFrame, table_path: str, alerts_path: str, checkpoint: str,
                       available_now: bool = False, processing_time: str | None = None) -> StreamingQuery:
    w = enrich(requests).writeStream.foreachBatch(_write_batch(table_path, alerts_path)) \
        .option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def _utc_instant(ntz):
    """The instant whose UTC wall clock equals a zone-free timestamp (session-zone independent)."""
    return F.make_timestamp_ltz(F.year(ntz), F.month(ntz), F.dayofmonth(ntz), F.hour(ntz), F.minute(ntz),
                                F.date_part(F.lit("SECOND"), ntz), F.lit("UTC"))


def quota_stream(requests: DataFrame, watermark: str = "1 day", limit: int = usage.DAILY_LIMIT,
                 exclude: str | None = None) -> DataFrame:
    """Daily quota per user as a windowed streaming aggregate (append mode emits closed days).

    Windows align to UTC days; the zone-free ``created_at`` is read as UTC, so the
    days match the batch ``usage_daily`` whatever the session time zone is.
    """
    calls = usage.api_calls(requests, exclude).where(F.col("user_id").isNotNull())
    calls = calls.withColumn("event_time", _utc_instant(F.col("created_at")))
    counted = (calls.withWatermark("event_time", watermark)
               .groupBy(F.window("event_time", "1 day"), "user_id")
               .agg(F.count(F.lit(1)).alias("used"), F.min(usage.day_of(F.col("created_at"))).alias("day")))
    return counted.select("user_id", "day", "used", *usage.quota(F.col("used"), limit))
