"""The ``events`` table seen as structured log events, by a fixed rule without chance.

Every column is a function of one event row, so a SQL engine can compute the expected result
of each log query straight from ``events``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INGEST_TS = "2024-02-01 00:00:00"
DEFAULT_YEAR = 2024

# A parcel depot: what its four services log.
SERVICES = ("parcel-router", "badge-gate", "stock-index", "kiosk-ui")
DEPARTMENTS = ("dispatch", "premises", "warehouse", "retail")
APP_IDS = ("depot.router", "depot.gate", "depot.stock", "depot.kiosk")
REGIONS = ("north-1", "harbour-2", "upland-3")
FORMATS = ("standard", "json", "syslog", "nginx")

# Owners of services: many-to-many.
CATALOG_ROWS = (
    ("parcel-router", "Dispatch", "routing@depot.example", "High"),
    ("parcel-router", "Dispatch", "night-shift@depot.example", "Low"),
    ("parcel-router", "Retail", "shops@depot.example", "Medium"),
    ("badge-gate", "Premises", "guards@depot.example", "High"),
    ("badge-gate", "Dispatch", "yard@depot.example", "Medium"),
    ("stock-index", "Warehouse", "shelves@depot.example", "High"),
    ("kiosk-ui", "Retail", "screens@depot.example", "Low"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nth(i: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))


def event_logs(spark: SparkSession, sf_dir: str, read=lambda df: df) -> DataFrame:
    """Structured log events, one per row of ``events``; ``read`` may lay the rows out anew."""
    e = read(table(spark, sf_dir, "events"))
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind, user, service = F.col("event_type"), F.col("user_id"), F.col("service_name")
    amount = F.col("value").cast("decimal(14,2)").cast("string")
    user_text, k_text = user.cast("string"), F.col("k").cast("string")

    base = e.select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        k.alias("k"),
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("timestamp"),
        _nth(user % 4, SERVICES).alias("service_name"),
        _nth(user % 4, DEPARTMENTS).alias("department"),
        _nth(user % 4, APP_IDS).alias("app_id"),
        F.when(kind == "error", "ERROR").when(kind == "signup", "WARN").otherwise("INFO").alias("severity"),
        F.lit("prod").alias("environment"),
        F.concat(F.lit("server-"), F.lpad((user % 100).cast("string"), 3, "0")).alias("host"),
        _nth(k % 3, REGIONS).alias("region"),
        F.when(F.col("event_id") % 97 == 0, "junk")
        .otherwise(_nth(F.col("event_id") % 4, FORMATS)).alias("line_format"),
    )
    ip = F.concat(
        F.lit("10."), (user % 200).cast("string"), F.lit("."), k_text, F.lit(".7")
    )
    message = (
        F.when(
            service == "parcel-router",
            F.when(kind == "signup", F.concat(F.lit("Receipt mailed to guest"), user_text, F.lit("@depot.example")))
            .when(
                kind == "purchase",
                F.concat(F.lit("Refund to card 5300-0000-7000-"), (F.col("k") + 1000).cast("string"),
                         F.lit(" over "), amount),
            )
            .otherwise(F.concat(F.lit("Parcel scanned at belt=b"), user_text, F.lit(" grams="), amount)),
        )
        .when(
            service == "badge-gate",
            F.when(
                kind == "error",
                F.concat(F.lit("Badge refused holder=h"), user_text, F.lit(" reader="), F.col("client_ip"),
                         F.lit(" cause=expired")),
            ).otherwise(
                F.concat(F.lit("Badge accepted holder=h"), user_text, F.lit(" reader="), F.col("client_ip"))
            ),
        )
        .when(
            service == "stock-index",
            F.concat(F.lit("Shelf counted aisle=a"), (F.col("k") % 3).cast("string"),
                     F.lit(" took="), k_text, F.lit("ms")),
        )
        .otherwise(F.concat(F.lit("Screen shown /item/"), k_text))
    )
    return base.withColumn("client_ip", ip).withColumns(
        {
            "message": message,
            "latency_ms": F.col("k"),
            "path": F.concat(F.lit("/item/"), k_text),
            "status": F.when(F.col("severity") == "INFO", 200).otherwise(500),
            "bytes": F.col("k") * 10 + 100,
            "trace_id": F.concat_ws("-", user_text, F.date_format("timestamp", "yyyyMMddHH")),
        }
    )


def logs_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event feed in the shape of the stored ``logs`` table, with its JSON context."""
    from cedarlog.functions.mask import mask_text
    from cedarlog.operators.templates import signature

    e = event_logs(spark, sf_dir).withColumn("message", mask_text(F.col("message")))
    return e.select(
        "timestamp",
        "severity",
        "service_name",
        "trace_id",
        signature(F.col("message")).alias("body"),
        "environment",
        "app_id",
        "department",
        "host",
        "region",
        F.to_json(
            F.struct("user_id", "latency_ms", "status", "path",
                     F.concat_ws(".", "service_name", F.lit("log")).alias("source_file"))
        ).alias("context"),
        "message",
        F.to_date("timestamp").alias("log_date"),
        "event_id",
    )


def access_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access-log rows (``body`` = request and status) of the same events."""
    e = event_logs(spark, sf_dir)
    return e.select(
        "timestamp",
        F.lit("nginx").alias("service_name"),
        F.concat(F.lit("GET "), "path", F.lit(" HTTP/1.1 "), F.col("status").cast("string")).alias("body"),
        F.to_json(F.struct(F.col("status").cast("string").alias("status"))).alias("context"),
    )


def catalog(spark: SparkSession) -> DataFrame:
    from cedarlog.schema import CATALOG

    return spark.createDataFrame(list(CATALOG_ROWS), CATALOG)
