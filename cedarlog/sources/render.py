"""Structured events as log lines in the four layouts, one file per service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cedarlog.functions.text import compute

# File written for each service.
SERVICE_FILES = {
    "parcel-router": "router.log",
    "badge-gate": "gate.log",
    "stock-index": "stock.log",
    "kiosk-ui": "kiosk.log",
}


def pick(key: Column, table: dict[str, str], default: str | None = None) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def meta_text() -> Column:
    return F.concat(
        F.lit("env="), "environment", F.lit(" region="), "region", F.lit(" host="), "host"
    )


def standard_line() -> Column:
    extra = F.concat(
        F.lit("user_id="), F.col("user_id").cast("string"),
        F.lit(" dept="), F.col("department"), F.lit(" app_id="), F.col("app_id"),
    )
    return F.concat(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), "severity", F.lit(" "),
        "service_name", F.lit(": "), "message", F.lit(" "), meta_text(), F.lit(" "), extra,
    )


def json_line() -> Column:
    return F.to_json(
        F.struct(
            F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("timestamp"),
            F.col("severity").alias("level"),
            F.col("service_name").alias("service"),
            "message", "host", "region", "user_id", "latency_ms",
            F.col("department").alias("dept"), "app_id",
        )
    )


def syslog_line() -> Column:
    return F.concat(
        F.date_format("timestamp", "MMM d HH:mm:ss"), F.lit(" "), "host", F.lit(" "),
        "service_name", F.lit("["), (F.col("user_id") + 100).cast("string"), F.lit("]: "),
        "message", F.lit(" "), meta_text(),
    )


def access_line() -> Column:
    return F.concat(
        "client_ip", F.lit(" - - ["),
        F.date_format("timestamp", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET '), "path",
        F.lit(' HTTP/1.1" '), F.col("status").cast("string"), F.lit(" "),
        F.col("bytes").cast("string"),
    )


def render_lines(events: DataFrame, fmt: str | Column) -> DataFrame:
    """Add ``value`` (the line) and ``file_name``; unknown formats give a free-text line."""
    f = F.lit(fmt) if isinstance(fmt, str) else fmt
    line = (
        F.when(f == "standard", standard_line())
        .when(f == "json", json_line())
        .when(f == "syslog", syslog_line())
        .when(f == "nginx", access_line())
        .otherwise(F.concat(F.lit("unreadable entry "), F.col("event_id").cast("string")))
    )
    return compute(
        events, {"value": line, "file_name": pick(F.col("service_name"), SERVICE_FILES)}
    )


def write_lines(rendered: DataFrame, folder: str) -> None:
    """Write lines under ``service_name=…`` folders; a busy service gets several files."""
    (
        rendered.select("service_name", "value")
        .hint("rebalance", "service_name")
        .write.mode("overwrite")
        .partitionBy("service_name")
        .text(folder)
    )
