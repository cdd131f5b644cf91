"""Batch = stream: the streaming forms give the batch results on the same input."""

import os
import shutil
import tempfile

from pyspark.sql import functions as F

from core_helpers import SF_SMALL
from jobledger.operators import audit, usage
from jobledger.plans.fixtures import audit_log_from
from jobledger.streaming.audit_stream import quota_stream, start_audit_stream


def _events_stream(spark, tmp):
    src = os.path.join(tmp, "events")
    os.makedirs(src)
    shutil.copy(f"{SF_SMALL}/events.parquet", os.path.join(src, "part-0.parquet"))
    schema = spark.read.parquet(src).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), src


def test_audit_stream_equals_batch(spark):
    tmp = tempfile.mkdtemp(prefix="jl-st1-")
    stream, src = _events_stream(spark, tmp)
    q = start_audit_stream(audit_log_from(stream), f"{tmp}/audit", f"{tmp}/alerts", f"{tmp}/ckpt",
                           available_now=True)
    q.awaitTermination(300)
    got = spark.read.parquet(f"{tmp}/audit").select("id", "service", "error_code").collect()
    batch = audit.audit_record(audit_log_from(spark.read.parquet(src))).select("id", "service", "error_code")
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch.collect()))
    alerts = spark.read.parquet(f"{tmp}/alerts").select("id").collect()
    batch_alerts = audit.alert_rows(audit.audit_record(audit_log_from(spark.read.parquet(src)))).select("id").collect()
    assert sorted(r.id for r in alerts) == sorted(r.id for r in batch_alerts)


def test_quota_stream_equals_batch(spark):
    tmp = tempfile.mkdtemp(prefix="jl-st2-")
    stream, src = _events_stream(spark, tmp)
    agg = quota_stream(audit_log_from(stream), watermark="1 day")
    q = (agg.writeStream.outputMode("update").format("memory").queryName("quota_st2")
         .option("checkpointLocation", f"{tmp}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination(300)
    # update mode emits every change; keep the last (largest) count per key
    got = spark.sql("SELECT user_id, day, max(used) AS used FROM quota_st2 GROUP BY user_id, day").collect()
    batch = usage.usage_daily(audit_log_from(spark.read.parquet(src))).select("user_id", "day", "used").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch))


def test_quota_stream_drops_late_calls(spark):
    """Lateness rule: a call older than the watermark (max event time - 1 day) is not counted."""
    import datetime as dt
    tmp = tempfile.mkdtemp(prefix="jl-late-")
    src = os.path.join(tmp, "events")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"

    def put(rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(os.path.join(tmp, name))
        part = [f for f in os.listdir(os.path.join(tmp, name)) if f.endswith(".parquet")][0]
        os.makedirs(src, exist_ok=True)
        shutil.copy(os.path.join(tmp, name, part), os.path.join(src, f"{name}.parquet"))

    day = lambda d, h=12: dt.datetime(2024, 1, d, h)
    # event_id values avoid the view's null-user / deleted shaping (multiples of 11 and 17)
    put([(1, day(1), 5, "view", 1.0, "{}"), (2, day(3), 5, "view", 1.0, "{}")], "b1")
    stream = spark.readStream.schema(schema).parquet(src)
    q = (quota_stream(audit_log_from(stream)).writeStream.outputMode("update").format("memory")
         .queryName("quota_late").option("checkpointLocation", f"{tmp}/ckpt").start())
    try:
        q.processAllAvailable()
        put([(3, day(1, 13), 5, "view", 1.0, "{}"), (4, day(3, 13), 5, "view", 1.0, "{}")], "b2")
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.day.day: r.used for r in spark.sql(
        "SELECT day, max(used) AS used FROM quota_late GROUP BY day").collect()}
    assert got == {1: 1, 3: 2}


def test_results_do_not_depend_on_session_zone(spark):
    """Zone-free inputs: batch days, the flagship and the stream give the same answer in any session zone."""
    import __spark_entry__ as E
    base = {q: sorted(map(tuple, E.queries()[q](spark, SF_SMALL).collect())) for q in ("usage_daily", "usage_rolling")}
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        for q, rows in base.items():
            assert sorted(map(tuple, E.queries()[q](spark, SF_SMALL).collect())) == rows, q
        tmp = tempfile.mkdtemp(prefix="jl-tz-")
        stream, src = _events_stream(spark, tmp)
        agg = quota_stream(audit_log_from(stream))
        qr = (agg.writeStream.outputMode("update").format("memory").queryName("quota_tz")
              .option("checkpointLocation", f"{tmp}/ckpt").trigger(availableNow=True).start())
        qr.awaitTermination(300)
        got = spark.sql("SELECT user_id, day, max(used) AS used FROM quota_tz GROUP BY user_id, day").collect()
        batch = [(r[0], r[1], r[2]) for r in base["usage_daily"]]
        assert sorted(map(tuple, got)) == sorted(batch)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_audit_record_optional_fields(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(
        [(1, "/api/chat", 500, '{"errorCode":"AI_SERVICE_ERROR","message":"m"}', 1200, '{"password":"p","a":1}',
          {"X-Api-Key": "k", "Accept": "json"}, None, "::1", "203.0.113.9")],
        "id long, path string, status_code int, response_body string, response_ms int, request_body string, "
        "request_headers map<string,string>, ip string, socket_address string, forwarded_for string")
    r = audit.audit_record(df).first()
    assert (r.service, r.error_code, r.error_message, r.is_slow) == ("CHAT", "AI_SERVICE_ERROR", "m", True)
    assert r.request_headers == {"X-Api-Key": "[REDACTED]", "Accept": "json"}
    assert r.ip_address == "::1" and r.request_body == '{"password":"[REDACTED]","a":1}'


def test_upkeep_counts_late_calls_after_a_restart(spark):
    """Late rows correct closed days, a replayed batch doubles nothing, a compaction changes no total."""
    import datetime as dt

    from jobledger.streaming.usage_upkeep import compact, daily_totals, deltas, start_usage_upkeep
    tmp = tempfile.mkdtemp(prefix="jl-upkeep-")
    src, path = f"{tmp}/events", f"{tmp}/deltas"
    os.makedirs(src)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    day = lambda d: dt.datetime(2024, 1, d, 12)
    batches = [[(1, day(1), 5, "view", 1.0, "{}"), (2, day(20), 5, "view", 1.0, "{}"), (3, day(20), 6, "view", 1.0, "{}")],
               [(4, day(1), 5, "view", 1.0, "{}"), (5, day(2), 6, "view", 1.0, "{}")],  # weeks late
               [(6, day(1), 5, "view", 1.0, "{}"), (7, day(20), 5, "purchase", 1.0, "{}")]]

    def run():
        stream = audit_log_from(spark.readStream.schema(schema).parquet(src))
        start_usage_upkeep(stream, path, f"{tmp}/ckpt", available_now=True).awaitTermination(120)

    def expected():
        return sorted(map(tuple, usage.usage_daily(audit_log_from(spark.read.schema(schema).parquet(src))).collect()))

    for n, rows in enumerate(batches):  # each run is a restart from the checkpoint
        out = f"{tmp}/b{n}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(out)
        part = next(f for f in os.listdir(out) if f.endswith(".parquet"))
        shutil.copy(f"{out}/{part}", f"{src}/b{n}.parquet")
        run()
        assert sorted(map(tuple, daily_totals(spark, path).collect())) == expected()
        if n == 1:
            compact(spark, path, 1)
            assert sorted(map(tuple, daily_totals(spark, path).collect())) == expected()
    replay = audit_log_from(spark.read.schema(schema).parquet(f"{src}/b2.parquet"))
    deltas(replay).write.mode("overwrite").parquet(f"{path}/generation=0/batch_id=2")  # what a replay writes
    assert sorted(map(tuple, daily_totals(spark, path).collect())) == expected()
