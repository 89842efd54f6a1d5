"""Questions about the ``logs`` table: counts, lists, groups, top-N, time ranges, catalog joins.

All of them take the same :class:`LogFilter`, so a follow-up question keeps its predicates and
only changes its shape from a count to a list.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Result sizes of the listing questions.
RECENT_ROWS = 10
LAST_ROWS = 5
RESOURCE_ROWS = 50
FOLLOW_UP_ROWS = 50
CHECK_ROWS = 3
TOP_ENDPOINTS = 5

ERROR, WARN = "ERROR", "WARN"


@dataclass(frozen=True)
class LogFilter:
    """Predicates on real columns. A time range also prunes ``log_date`` partitions."""

    service: str | None = None
    severity: str | None = None
    since: str | None = None
    until: str | None = None

    def column(self, has_date: bool = True) -> Column:
        cond = F.lit(True)
        if self.service is not None:
            cond = cond & (F.col("service_name") == self.service)
        if self.severity is not None:
            cond = cond & (F.col("severity") == self.severity)
        if self.since is not None:
            since = F.lit(self.since).cast("timestamp")
            cond = cond & (F.col("timestamp") >= since)
            if has_date:
                cond = cond & (F.col("log_date") >= F.to_date(since))
        if self.until is not None:
            until = F.lit(self.until).cast("timestamp")
            cond = cond & (F.col("timestamp") < until)
            if has_date:
                cond = cond & (F.col("log_date") <= F.to_date(until))
        return cond

    def apply(self, logs: DataFrame) -> DataFrame:
        return logs.filter(self.column("log_date" in logs.columns))

    def but(self, **changes) -> LogFilter:
        return replace(self, **changes)


def since_days(as_of: str, days: int = 1) -> str:
    """Start of the day ``days`` days before the day of ``as_of``, as text."""
    from datetime import datetime, timedelta

    day = datetime.fromisoformat(as_of).replace(hour=0, minute=0, second=0, microsecond=0)
    return (day - timedelta(days=days)).isoformat(sep=" ")


def since_hours(as_of: str, hours: int = 24) -> str:
    from datetime import datetime, timedelta

    return (datetime.fromisoformat(as_of) - timedelta(hours=hours)).isoformat(sep=" ")


def count_logs(logs: DataFrame, where: LogFilter = LogFilter()) -> DataFrame:
    return where.apply(logs).agg(F.count("*").alias("n"))


def list_logs(
    logs: DataFrame,
    where: LogFilter = LogFilter(),
    n: int = FOLLOW_UP_ROWS,
    tie_break: str = "message",
) -> DataFrame:
    """The latest ``n`` rows; ``tie_break`` makes the order total."""
    return where.apply(logs).orderBy(F.desc("timestamp"), F.asc(tie_break)).limit(n)


def all_logs(logs: DataFrame, where: LogFilter) -> DataFrame:
    return where.apply(logs)


def distinct_services(logs: DataFrame) -> DataFrame:
    return logs.select("service_name").distinct()


def count_by(logs: DataFrame, key: str | Column, name: str, where: LogFilter = LogFilter()) -> DataFrame:
    """Rows per key, most frequent first."""
    column = F.col(key) if isinstance(key, str) else key
    return (
        where.apply(logs)
        .groupBy(column.alias(name))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), name)
    )


def context_value(key: str, context: str = "context") -> Column:
    return F.get_json_object(context, f"$.{key}")


def context_number(key: str, context: str = "context") -> Column:
    return context_value(key, context).try_cast("double")


def measure_by(logs: DataFrame, key: str, measure: Column) -> DataFrame:
    """Count, mean, exact median and largest value of a measure per key."""
    return (
        logs.select(key, measure.alias("m"))
        .filter(F.col("m").isNotNull())
        .groupBy(key)
        .agg(
            F.count("*").alias("n"),
            F.round(F.avg("m"), 6).alias("mean"),
            F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY m)").alias("median"),
            F.max("m").alias("largest"),
        )
    )


def top_failing_service(logs: DataFrame, n: int = 1) -> DataFrame:
    return count_by(logs, "service_name", "service_name", LogFilter(severity=ERROR)).limit(n)


def failing_endpoints(logs: DataFrame, n: int = TOP_ENDPOINTS) -> DataFrame:
    """Request paths with the most 5xx answers.

    The request is read from ``message`` (stored rows keep their template as ``body``), the status from
    the context, or else from the end of the message.
    """
    text = F.col("message" if "message" in logs.columns else "body")
    status = F.coalesce(
        context_value("status").try_cast("int"), F.regexp_extract(text, r" (\d{3})$", 1).try_cast("int")
    )
    return (
        logs.select(F.regexp_extract(text, r"^[A-Z]+ (/\S*)", 1).alias("endpoint"), status.alias("status"))
        .filter((F.col("endpoint") != "") & (F.col("status") >= 500))
        .groupBy("endpoint")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "endpoint")
        .limit(n)
    )


def error_rate(logs: DataFrame, every: str = "1 hour") -> DataFrame:
    """Rows and share of errors per period; works on streams with a watermark too."""
    bad = (F.col("severity") == ERROR).cast("int")
    return logs.groupBy(F.window("timestamp", every).alias("w")).agg(
        F.count("*").alias("n"), F.sum(bad).alias("errors")
    ).select(
        F.col("w.start").alias("period"), "n", "errors",
        F.round(F.col("errors") / F.col("n"), 6).alias("rate"),
    )


def errors_by_department(logs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Errors per department. Logs are counted per service first, so the join sees few rows."""
    per_service = _errors_per_service(logs)
    owners = catalog.select("system_name", F.col("department").alias("dept"))
    return (
        per_service.join(owners, F.col("service_name") == F.col("system_name"))
        .groupBy(F.col("dept").alias("department"))
        .agg(F.sum("n").alias("error_count"))
        .orderBy(F.desc("error_count"), "department")
    )


def _errors_per_service(logs: DataFrame, *more: Column) -> DataFrame:
    return (
        logs.filter(F.col("severity") == ERROR)
        .groupBy("service_name", *more)
        .agg(F.count("*").alias("n"))
    )


def errors_by_department_week(logs: DataFrame, catalog: DataFrame) -> DataFrame:
    week = F.date_trunc("week", "timestamp").alias("week")
    owners = catalog.select("system_name", F.col("department").alias("dept"))
    return (
        _errors_per_service(logs, week)
        .join(owners, F.col("service_name") == F.col("system_name"))
        .groupBy(F.col("dept").alias("department"), "week")
        .agg(F.sum("n").alias("error_count"))
    )


def failing_service_owner(logs: DataFrame, catalog: DataFrame) -> DataFrame:
    """The service with the most errors, and whom it belongs to."""
    worst = top_failing_service(logs)
    owners = catalog.select("system_name", "owner_email", "criticality")
    return worst.join(owners, F.col("service_name") == F.col("system_name")).select(
        "system_name", "owner_email", "criticality", F.col("n").alias("error_count")
    )


def logs_of_department(logs: DataFrame, catalog: DataFrame, department: str) -> DataFrame:
    systems = catalog.filter(F.col("department") == department).select(
        F.col("system_name").alias("service_name")
    )
    return logs.join(systems, "service_name", "left_semi")


def impact(logs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Departments hit by failures, by criticality; a log counts once in each pair of both."""
    owners = catalog.select(F.col("department").alias("dept"), "system_name", "criticality").distinct()
    return (
        _errors_per_service(logs)
        .join(owners, F.col("service_name") == F.col("system_name"))
        .groupBy(F.col("dept").alias("department"), "criticality")
        .agg(
            F.sum("n").alias("error_count"),
            F.array_join(F.array_sort(F.collect_set("service_name")), ",").alias("services"),
        )
    )


def daily_change(logs: DataFrame, *keys: str) -> DataFrame:
    """Rows per day and key, with the change against the calendar day before."""
    daily = logs.groupBy(*keys, F.to_date("timestamp").alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy("day")
    previous = F.when(
        F.datediff("day", F.lag("day").over(w)) == 1, F.lag("n").over(w)
    ).otherwise(F.lit(0))
    return daily.withColumn("previous", previous).withColumn(
        "change", F.col("n") - F.col("previous")
    )
