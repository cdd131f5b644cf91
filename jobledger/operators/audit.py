"""Request-log enrichment, error fields, slow requests and alert rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonx import parse_response, sanitize_headers, sanitize_json, with_error_fields
from ..functions.rules import (alert_gate, alert_text, client_ip, is_slow, needs_attention, origin_class,
                               service_name, status_for_code)
from ..functions.text import error_title


def audit_record(requests: DataFrame) -> DataFrame:
    """Audit row per request: service, slow flag, error code/message from the response.

    Optional inputs are used when present: ``request_headers`` (map, redacted),
    ``ip`` / ``socket_address`` / ``forwarded_for`` (-> ``ip_address``).
    Bodies are redacted and cut; there is no form of the record with raw bodies.
    ``user_email`` is only for alerting and is dropped before the audit sink.
    """
    out = (requests.withColumn("service", service_name(F.col("path")))
                   .withColumn("is_slow", is_slow(F.col("response_ms"))))
    out = with_error_fields(out, "status_code", "response_body")
    if "request_headers" in out.columns:
        out = out.withColumn("request_headers", sanitize_headers(F.col("request_headers")))
    addr = [c for c in ("ip", "socket_address", "forwarded_for") if c in out.columns]
    if addr:
        cols = [F.col(c) for c in addr] + [F.lit(None).cast("string")] * (3 - len(addr))
        out = out.withColumn("ip_address", client_ip(*cols))
    if "request_body" in out.columns:
        out = out.withColumn("request_body", sanitize_json("request_body"))
    if "response_body" in out.columns:
        out = out.withColumn("response_body", parse_response("response_body"))
    return out.drop("user_email")


def slow_requests(audit: DataFrame) -> DataFrame:
    return audit.where(is_slow(F.col("response_ms")))


def alert_rows(audit: DataFrame) -> DataFrame:
    """Rows that would page a developer: gate (code set or >= 500) and attention rule."""
    return audit.where(alert_gate(F.col("status_code"), F.col("error_code"))
                       & needs_attention(F.col("status_code"), F.col("error_code")))


def alert_messages(audit: DataFrame, users: DataFrame) -> DataFrame:
    """Alert text per alert row; the user's e-mail comes from a join after the filter."""
    rows = alert_rows(audit).withColumn("service", service_name(F.col("path")))
    u = users.select(F.col("id").alias("_uid"), F.col("email").alias("user_email"))
    j = rows.join(u, rows.user_id == u._uid, "left")
    msg = F.col("error_message") if "error_message" in rows.columns else F.lit(None).cast("string")
    return j.select("id", "service", "status_code", "error_code",
                    alert_text(F.col("service"), F.col("error_code"), msg, F.col("status_code"),
                               F.col("user_email"), F.col("user_id"), F.col("path")).alias("alert_text"))


def error_status(audit: DataFrame) -> DataFrame:
    """HTTP status and readable title for each stored error code."""
    e = audit.where(F.col("error_code").isNotNull())
    return e.select("id", "error_code", status_for_code(F.col("error_code")).alias("http_status"),
                    error_title(F.col("error_code")).alias("title"))


def origins(audit: DataFrame, production_origins: tuple[str, ...] = ()) -> DataFrame:
    return audit.select("id", origin_class(F.col("origin"), production_origins).alias("origin_class"))
