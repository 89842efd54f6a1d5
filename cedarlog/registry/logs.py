"""Questions about the ``logs`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from cedarlog.operators import queries as q
from cedarlog.operators.queries import ERROR, WARN, LogFilter
from cedarlog.registry.base import CATALOG_SQL, query, sql_stamp, stamp, with_feed
from cedarlog.sources import feed
from cedarlog.sources.tables import after_cutover, run_sql

AS_OF = "2024-01-20 12:30:00"
_ROW = f"event_id, {sql_stamp('ts')} AS ts, severity, service_name, body"


def _rows(df):
    return df.select("event_id", stamp().alias("ts"), "severity", "service_name", "body")


def _listing(where: str, n: int) -> str:
    return with_feed(f"SELECT {_ROW} FROM logs {where} ORDER BY logs.ts DESC, event_id LIMIT {n}")


@query(
    "count_errors_service",
    with_feed("SELECT count(*) AS n FROM logs WHERE service_name = 'badge-gate' AND severity = 'ERROR'"),
)
def count_errors_service(spark, d):
    return q.count_logs(feed.logs_view(spark, d), LogFilter("badge-gate", ERROR))


@query("recent_warnings", _listing("WHERE severity = 'WARN'", 10))
def recent_warnings(spark, d):
    return _rows(q.list_logs(feed.logs_view(spark, d), LogFilter(severity=WARN), q.RECENT_ROWS, "event_id"))


@query("last_n_logs", _listing("", 5))
def last_n_logs(spark, d):
    return _rows(q.list_logs(feed.logs_view(spark, d), n=q.LAST_ROWS, tie_break="event_id"))


@query("recent_resource", _listing("", 50))
def recent_resource(spark, d):
    return _rows(q.list_logs(feed.logs_view(spark, d), n=q.RESOURCE_ROWS, tie_break="event_id"))


@query("distinct_services", with_feed("SELECT DISTINCT service_name FROM logs"))
def distinct_services(spark, d):
    return q.distinct_services(feed.logs_view(spark, d))


@query(
    "count_since",
    with_feed(
        """SELECT count(*) AS n FROM logs WHERE service_name = 'parcel-router'
        AND ts >= DATE '2024-01-20' - INTERVAL 1 DAY"""
    ),
)
def count_since(spark, d):
    return q.count_logs(feed.logs_view(spark, d), LogFilter("parcel-router", since=q.since_days(AS_OF)))


@query(
    "followup_list",
    _listing("WHERE service_name = 'parcel-router' AND logs.ts >= DATE '2024-01-20' - INTERVAL 1 DAY", 50),
)
def followup_list(spark, d):
    asked = LogFilter("parcel-router", since=q.since_days(AS_OF))
    return _rows(q.list_logs(feed.logs_view(spark, d), asked, q.FOLLOW_UP_ROWS, "event_id"))


@query("total_count", with_feed("SELECT count(*) AS n FROM logs"))
def total_count(spark, d):
    return q.count_logs(feed.logs_view(spark, d))


@query("logs_by_service", with_feed("SELECT service_name, count(*) AS n FROM logs GROUP BY 1"))
def logs_by_service(spark, d):
    return q.count_by(feed.logs_view(spark, d), "service_name", "service_name")


@query(
    "logs_by_source_file",
    with_feed("SELECT service_name || '.log' AS source_file, count(*) AS n FROM logs GROUP BY 1"),
)
def logs_by_source_file(spark, d):
    return q.count_by(feed.logs_view(spark, d), q.context_value("source_file"), "source_file")


@query(
    "mask_check_rows",
    with_feed(
        """SELECT event_id, body, CAST(user_id AS VARCHAR) AS ctx_user, '/item/' || k AS ctx_path
        FROM logs ORDER BY ts DESC, event_id LIMIT 3"""
    ),
)
def mask_check_rows(spark, d):
    rows = q.list_logs(feed.logs_view(spark, d), n=q.CHECK_ROWS, tie_break="event_id")
    return rows.select(
        "event_id", "body", q.context_value("user_id").alias("ctx_user"), q.context_value("path").alias("ctx_path")
    )


@query(
    "top_failing_service",
    with_feed(
        """SELECT service_name, count(*) AS n FROM logs WHERE severity = 'ERROR' GROUP BY 1
        ORDER BY n DESC, service_name LIMIT 1"""
    ),
)
def top_failing_service(spark, d):
    return q.top_failing_service(feed.logs_view(spark, d))


@query(
    "errors_last_24h",
    with_feed(
        """SELECT count(*) AS n FROM logs WHERE severity = 'ERROR'
        AND ts >= TIMESTAMP '2024-01-20 12:30:00' - INTERVAL 24 HOUR AND ts < TIMESTAMP '2024-01-20 12:30:00'"""
    ),
)
def errors_last_24h(spark, d):
    where = LogFilter(severity=ERROR, since=q.since_hours(AS_OF), until=AS_OF)
    return q.count_logs(feed.logs_view(spark, d), where)


@query(
    "errors_of_service",
    with_feed(f"SELECT {_ROW} FROM logs WHERE severity = 'ERROR' AND service_name = 'parcel-router'"),
)
def errors_of_service(spark, d):
    return _rows(q.all_logs(feed.logs_view(spark, d), LogFilter("parcel-router", ERROR)))


@query(
    "top_failing_endpoints",
    with_feed(
        """SELECT '/item/' || k AS endpoint, count(*) AS n FROM feed WHERE status >= 500 GROUP BY 1
        ORDER BY n DESC, endpoint LIMIT 5"""
    ),
)
def top_failing_endpoints(spark, d):
    return q.failing_endpoints(feed.access_view(spark, d))


@query(
    "error_rate_hourly",
    with_feed(
        f"""SELECT {sql_stamp("date_trunc('hour', ts)")} AS period, count(*) AS n,
        CAST(count(*) FILTER (WHERE severity = 'ERROR') AS BIGINT) AS errors,
        round(count(*) FILTER (WHERE severity = 'ERROR') / count(*), 6) AS rate FROM logs GROUP BY 1"""
    ),
)
def error_rate_hourly(spark, d):
    return q.error_rate(feed.logs_view(spark, d)).withColumn("period", stamp("period"))


@query(
    "json_path_measure",
    with_feed(
        """SELECT service_name, count(*) AS n, round(avg(k), 6) AS mean,
        CAST(quantile_disc(k, 0.5) AS DOUBLE) AS median, CAST(max(k) AS DOUBLE) AS largest FROM logs GROUP BY 1"""
    ),
)
def json_path_measure(spark, d):
    return q.measure_by(feed.logs_view(spark, d), "service_name", q.context_number("latency_ms"))


def _cat(body: str) -> str:
    return with_feed(f", {CATALOG_SQL} {body}")


@query(
    "errors_by_department",
    _cat(
        """SELECT c.department, count(*) AS error_count FROM logs l JOIN catalog c ON l.service_name = c.system_name
        WHERE l.severity = 'ERROR' GROUP BY 1"""
    ),
)
def errors_by_department(spark, d):
    return q.errors_by_department(feed.logs_view(spark, d), feed.catalog(spark))


@query(
    "errors_by_department_week",
    _cat(
        f"""SELECT c.department, {sql_stamp("date_trunc('week', ts)")} AS week, count(*) AS error_count
        FROM logs l JOIN catalog c ON l.service_name = c.system_name WHERE l.severity = 'ERROR' GROUP BY 1, 2"""
    ),
)
def errors_by_department_week(spark, d):
    return q.errors_by_department_week(feed.logs_view(spark, d), feed.catalog(spark)).withColumn(
        "week", stamp("week")
    )


@query(
    "failing_service_owner",
    _cat(
        """, worst AS (SELECT service_name, count(*) AS n FROM logs WHERE severity = 'ERROR' GROUP BY 1
                      ORDER BY n DESC, 1 LIMIT 1)
        SELECT system_name, owner_email, criticality, n AS error_count FROM worst
        JOIN catalog ON service_name = system_name"""
    ),
)
def failing_service_owner(spark, d):
    return q.failing_service_owner(feed.logs_view(spark, d), feed.catalog(spark))


@query(
    "department_logs_semi",
    _cat(
        """SELECT service_name, severity, count(*) AS n FROM logs WHERE service_name IN
        (SELECT system_name FROM catalog WHERE department = 'Dispatch') GROUP BY 1, 2"""
    ),
)
def department_logs_semi(spark, d):
    rows = q.logs_of_department(feed.logs_view(spark, d), feed.catalog(spark), "Dispatch")
    return rows.groupBy("service_name", "severity").agg(F.count("*").alias("n"))


@query(
    "impact_by_criticality",
    _cat(
        """SELECT c.department, c.criticality, count(DISTINCT event_id) AS error_count,
        string_agg(DISTINCT l.service_name, ',' ORDER BY l.service_name) AS services
        FROM logs l JOIN catalog c ON l.service_name = c.system_name WHERE l.severity = 'ERROR' GROUP BY 1, 2"""
    ),
)
def impact_by_criticality(spark, d):
    return q.impact(feed.logs_view(spark, d), feed.catalog(spark))


_CHANGE = """, daily AS (SELECT {keys}, CAST(ts AS DATE) AS day, count(*) AS n FROM logs WHERE {where} GROUP BY ALL)
SELECT {akeys}, strftime(a.day, '%Y-%m-%d') AS day, a.n, coalesce(b.n, 0) AS previous, a.n - coalesce(b.n, 0) AS change
FROM daily a LEFT JOIN daily b ON {on} AND b.day = a.day - INTERVAL 1 DAY"""


@query(
    "spike_vs_previous_day",
    with_feed(
        _CHANGE.format(
            keys="service_name", akeys="a.service_name", on="a.service_name = b.service_name",
            where="severity = 'ERROR'",
        )
    ),
)
def spike_vs_previous_day(spark, d):
    rows = feed.logs_view(spark, d).filter(F.col("severity") == ERROR)
    return q.daily_change(rows, "service_name").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "spike_by_template",
    with_feed(
        _CHANGE.format(
            keys="service_name, body", akeys="a.service_name, a.body",
            on="a.service_name = b.service_name AND a.body = b.body", where="true",
        )
    ),
)
def spike_by_template(spark, d):
    return q.daily_change(feed.logs_view(spark, d), "service_name", "body").withColumn(
        "day", F.date_format("day", "yyyy-MM-dd")
    )


@query(
    "raw_sql",
    with_feed(
        """SELECT service_name, count(*) AS n FROM logs WHERE severity = 'ERROR'
        AND k >= 50 GROUP BY service_name"""
    ),
)
def raw_sql(spark, d):
    text = """SELECT service_name, count(*) AS n FROM {logs}
        WHERE severity = 'ERROR' AND CAST(context:latency_ms AS INT) >= 50 GROUP BY service_name"""
    text = text.replace("context:latency_ms", "get_json_object(context, '$.latency_ms')")
    return run_sql(spark, text, logs=feed.logs_view(spark, d))


@query(
    "cutover_union",
    with_feed(
        """SELECT service_name, count(*) AS n FROM logs GROUP BY 1"""
    ),
)
def cutover_union(spark, d):
    """History up to a day, and a live feed that overlaps it by days: nothing twice, nothing lost."""
    rows = feed.logs_view(spark, d)
    history = rows.filter(F.col("timestamp") < "2024-01-16")
    live = rows.filter(F.col("timestamp") >= "2024-01-10")
    return after_cutover(history, live).groupBy("service_name").agg(F.count("*").alias("n"))
