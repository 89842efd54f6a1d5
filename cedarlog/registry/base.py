"""Registration of queries, and the SQL twin of the event feed."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cedarlog.sources import feed, render
from cedarlog.sources.lines import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` gives the same columns and rows in a SQL engine."""

    def register(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


def stamp(c: str | Column = "timestamp") -> Column:
    """A time as text, the same in every engine."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, value, source_file, event_ts``: the event feed as log lines."""
    e = feed.event_logs(spark, sf_dir, spread)
    return render.render_lines(e, F.col("line_format")).select(
        "event_id", "value", F.col("file_name").alias("source_file"),
        F.col("timestamp").alias("event_ts"),
    )


# The event feed in SQL: computed from ``events`` alone, with masked texts written out.
FEED = """
feed0 AS (
  SELECT event_id, user_id, event_type, value, date_trunc('second', ts) AS ts,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
         CAST(CAST(value AS DECIMAL(14,2)) AS VARCHAR) AS amount,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS severity,
         CASE user_id % 4 WHEN 0 THEN 'parcel-router' WHEN 1 THEN 'badge-gate'
              WHEN 2 THEN 'stock-index' ELSE 'kiosk-ui' END AS service_name,
         CASE user_id % 4 WHEN 0 THEN 'dispatch' WHEN 1 THEN 'premises'
              WHEN 2 THEN 'warehouse' ELSE 'retail' END AS department,
         CASE user_id % 4 WHEN 0 THEN 'depot.router' WHEN 1 THEN 'depot.gate'
              WHEN 2 THEN 'depot.stock' ELSE 'depot.kiosk' END AS app_id,
         CASE user_id % 4 WHEN 0 THEN 'router.log' WHEN 1 THEN 'gate.log'
              WHEN 2 THEN 'stock.log' ELSE 'kiosk.log' END AS file_name,
         'server-' || lpad(CAST(user_id % 100 AS VARCHAR), 3, '0') AS host,
         CASE WHEN event_id % 97 = 0 THEN 'fallback' WHEN event_id % 4 = 0 THEN 'standard'
              WHEN event_id % 4 = 1 THEN 'json' WHEN event_id % 4 = 2 THEN 'syslog'
              ELSE 'nginx' END AS format
  FROM events),
feed AS (
  SELECT *,
    CASE k % 3 WHEN 0 THEN 'north-1' WHEN 1 THEN 'harbour-2' ELSE 'upland-3' END AS region,
    CASE WHEN severity = 'INFO' THEN 200 ELSE 500 END AS status,
    '10.' || (user_id % 200) || '.' || k || '.7' AS ip,
    user_id || '-' || strftime(ts, '%Y%m%d%H') AS trace_id,
    CASE service_name
      WHEN 'parcel-router' THEN CASE event_type
        WHEN 'signup' THEN 'Receipt mailed to <EMAIL_REDACTED>'
        WHEN 'purchase' THEN 'Refund to card <CC_REDACTED> over ' || amount
        ELSE 'Parcel scanned at belt=b' || user_id || ' grams=' || amount END
      WHEN 'badge-gate' THEN CASE event_type
        WHEN 'error' THEN 'Badge refused holder=h' || user_id || ' reader=<IP_REDACTED> cause=expired'
        ELSE 'Badge accepted holder=h' || user_id || ' reader=<IP_REDACTED>' END
      WHEN 'stock-index' THEN 'Shelf counted aisle=a' || (k % 3) || ' took=' || k || 'ms'
      ELSE 'Screen shown /item/' || k END AS message,
    CASE service_name
      WHEN 'parcel-router' THEN CASE event_type
        WHEN 'signup' THEN 'Receipt mailed to <EMAIL_REDACTED>'
        WHEN 'purchase' THEN 'Refund to card <CC_REDACTED> over <*>'
        ELSE 'Parcel scanned at <*> <*>' END
      WHEN 'badge-gate' THEN CASE event_type
        WHEN 'error' THEN 'Badge refused <*> reader=<IP_REDACTED> cause=expired'
        ELSE 'Badge accepted <*> reader=<IP_REDACTED>' END
      WHEN 'stock-index' THEN 'Shelf counted <*> <*>'
      ELSE 'Screen shown <*>' END AS template
  FROM feed0),
logs AS (SELECT *, template AS body, CAST(ts AS DATE) AS log_date FROM feed)
"""

# What the parser must find in each rendered line.
PARSED = (
    FEED
    + """,
meta AS (SELECT *, ' env=prod region=' || region || ' host=' || host AS meta_text FROM feed),
parsed AS (
  SELECT event_id, format, ts AS event_ts, file_name,
    CASE WHEN format = 'fallback' THEN TIMESTAMP '2024-02-01 00:00:00' ELSE ts END AS ts,
    CASE WHEN format IN ('standard', 'json') THEN severity WHEN format = 'fallback' THEN 'UNKNOWN'
         ELSE 'INFO' END AS severity,
    CASE format WHEN 'nginx' THEN 'nginx' WHEN 'fallback' THEN 'unknown' ELSE service_name END AS service_name,
    CASE format
      WHEN 'standard' THEN message || meta_text || ' user_id=' || user_id || ' dept=' || department
                           || ' app_id=' || app_id
      WHEN 'json' THEN message
      WHEN 'syslog' THEN message || meta_text
      WHEN 'nginx' THEN 'GET /item/' || k || ' HTTP/1.1 ' || status
      ELSE 'unreadable entry ' || event_id END AS message,
    CASE WHEN format = 'standard' THEN 'prod' END AS environment,
    CASE WHEN format IN ('standard', 'json') THEN app_id END AS app_id,
    CASE WHEN format IN ('standard', 'json') THEN department END AS department,
    CASE WHEN format IN ('standard', 'json', 'syslog') THEN host END AS host,
    CASE WHEN format IN ('standard', 'json') THEN region END AS region,
    CASE WHEN format = 'fallback' THEN 'format_unknown' END AS parse_error
  FROM meta)
"""
)

CATALOG_SQL = "catalog(system_name, department, owner_email, criticality) AS (VALUES " + ", ".join(
    "(" + ", ".join(f"'{v}'" for v in row) + ")" for row in feed.CATALOG_ROWS
) + ")"

SQL_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def sql_stamp(c: str) -> str:
    return SQL_STAMP.format(c)


def with_feed(body: str) -> str:
    return f"WITH {FEED} {body}"


def with_parsed(body: str) -> str:
    return f"WITH {PARSED} {body}"


def sql_mask(c: str) -> str:
    """Masking in a dialect without look-around: addresses share separators, so twice."""
    octet = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
    ip = f"(^|[^0-9])((?:{octet}[.]){{3}}{octet})($|[^0-9])"
    out = f"regexp_replace({c}, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+', '<EMAIL_REDACTED>', 'g')"
    for _ in range(2):
        out = f"regexp_replace({out}, '{ip}', '\\1<IP_REDACTED>\\3', 'g')"
    out = f"regexp_replace({out}, '\\b(?:\\d[ -]*?){{13,16}}\\b', '<CC_REDACTED>', 'g')"
    return f"regexp_replace({out}, '\\b\\d{{3}}-\\d{{2}}-\\d{{4}}\\b', '<SSN_REDACTED>', 'g')"
