"""Jobs over stored history: anomalies, noise, incidents, reports, risk, forecast, retention.

Each one reduces rows to counts per key and period before any window runs, so a window sees
the number of periods, not the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cedarlog.operators.joins import broadcast_if_small
from cedarlog.operators.queries import ERROR
from cedarlog.session import materialise, scratch_scope
from cedarlog.sources.lines import path_exists, remove_folder

# Age limits of storage tiers in days.
WARM_AFTER_DAYS = 30
COLD_AFTER_DAYS = 365

HISTORY_HOURS = 24
Z_LIMIT = 3.0


def hourly_counts(logs: DataFrame, *keys: str) -> DataFrame:
    return logs.groupBy(*keys, F.date_trunc("hour", "timestamp").alias("hour")).agg(
        F.count("*").alias("n")
    )


def anomaly_scores(logs: DataFrame, *keys: str, hours: int = HISTORY_HOURS) -> DataFrame:
    """Hourly counts with their z-score against the counts of the ``hours`` hours before.

    The frame is a range of time, so hours without rows do not stretch it.
    """
    seconds = F.col("hour").cast("long")
    w = Window.partitionBy(*keys).orderBy(seconds).rangeBetween(-hours * 3600, -1)
    scored = (
        hourly_counts(logs, *keys)
        .withColumn("mean", F.avg("n").over(w))
        .withColumn("dev", F.stddev_samp("n").over(w))
    )
    return scored.withColumn(
        "z", F.when(F.col("dev") > 0, (F.col("n") - F.col("mean")) / F.col("dev"))
    )


def anomalies(logs: DataFrame, *keys: str, limit: float = Z_LIMIT, hours: int = HISTORY_HOURS) -> DataFrame:
    return anomaly_scores(logs, *keys, hours=hours).filter(F.col("z") > limit)


def noisy_templates(logs: DataFrame, share: float, severity: str = "INFO") -> DataFrame:
    """Templates of low severity that make up more than ``share`` of all rows; rows are read once."""
    counted = logs.groupBy("template_id", "severity").agg(F.count("*").alias("n"))
    total = F.broadcast(counted.agg(F.sum("n").alias("_total")))  # one row, from the same counts
    return (
        counted.join(total)
        .filter((F.col("severity") == severity) & (F.col("n") > F.lit(share) * F.col("_total")))
        .drop("_total")
    )


def without_noise(logs: DataFrame, share: float, severity: str = "INFO") -> DataFrame:
    """Rows left when noisy templates are dropped; at most 1/share templates can be noisy."""
    noisy = noisy_templates(logs, share, severity).select("template_id", "severity")
    return logs.join(F.broadcast(noisy), ["template_id", "severity"], "left_anti")


def correlated_traces(logs: DataFrame, least: int = 2) -> DataFrame:
    """Traces with errors in at least ``least`` services."""
    bad = F.col("severity") == ERROR
    return (
        logs.filter(bad & F.col("trace_id").isNotNull())
        .groupBy("trace_id")
        .agg(
            F.count("*").alias("errors"),
            F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"),
            F.array_join(F.array_sort(F.collect_set("service_name")), ",").alias("services"),
            F.count_distinct("service_name").alias("n_services"),
        )
        .filter(F.col("n_services") >= least)
    )


def followed_by(
    logs: DataFrame, first: Column, then: Column, key: str, minutes: int = 5
) -> DataFrame:
    """For each key: rows of kind ``first``, and pairs with a ``then`` row up to ``minutes`` later.

    Rows are counted per key and second before the window, and keys are cut into time slices
    with an overlap of the window length, so neither a busy key nor a long history lands in
    one task. Pairs are counted, not built.
    """
    span = minutes * 60
    width = max(span, 3600)
    sec = F.col("timestamp").cast("long")
    per_second = (
        logs.filter(first | then)
        .groupBy(key, sec.alias("sec"))
        .agg(
            F.sum(first.cast("long")).alias("a"),
            F.sum(then.cast("long")).alias("b"),
        )
    )
    slice_no = F.floor(F.col("sec") / width)
    # A second that an earlier slice can look ahead to is copied there, without its own ``a``.
    copies = F.array_compact(
        F.array(
            F.struct(slice_no.alias("slice"), F.col("a").alias("a")),
            F.when(
                F.col("sec") - slice_no * width <= span,
                F.struct((slice_no - 1).alias("slice"), F.lit(0).cast("long").alias("a")),
            ),
        )
    )
    w = Window.partitionBy(key, "slice").orderBy("sec").rangeBetween(0, span)
    return (
        per_second.select(key, "sec", "b", F.explode(copies).alias("c"))
        .select(key, "sec", "b", "c.slice", "c.a")
        .withColumn("ahead", F.sum("b").over(w))
        .groupBy(key)
        .agg(F.sum("a").alias("n_first"), F.sum(F.col("a") * F.col("ahead")).alias("pairs"))
        .filter(F.col("n_first") > 0)
    )


def incidents(logs: DataFrame, key: str, gap_minutes: int = 10) -> DataFrame:
    """Runs of errors of one key without a pause longer than the gap.

    Errors inside one gap-wide slice always belong together, so they become one row before the
    runs are formed; the result is that of a session window over the single rows.
    """
    gap = gap_minutes * 60
    t = F.unix_micros("timestamp")
    slices = (
        logs.filter(F.col("severity") == ERROR)
        .groupBy(key, F.floor(t / (gap * 1_000_000)).alias("slice"))
        .agg(
            F.min("timestamp").alias("lo"),
            F.max("timestamp").alias("hi"),
            F.count("*").alias("n"),
        )
    )
    w = Window.partitionBy(key).orderBy("slice")
    pause = F.unix_micros("lo") - F.unix_micros(F.lag("hi").over(w))
    starts = F.when(pause <= gap * 1_000_000, 0).otherwise(1)
    return (
        slices.withColumn("_start", starts)
        .withColumn("incident", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(key, "incident")
        .agg(F.min("lo").alias("started"), F.max("hi").alias("ended"), F.sum("n").alias("errors"))
    )


def period_report(logs: DataFrame) -> DataFrame:
    """Counts, first and last time per day and service, per day, and in total."""
    return (
        logs.withColumn("day", F.to_date("timestamp"))
        .rollup("day", "service_name")
        .agg(
            F.count("*").alias("n"),
            F.sum((F.col("severity") == ERROR).cast("long")).alias("errors"),
            F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"),
        )
    )


def top_template(logs: DataFrame) -> DataFrame:
    """The most frequent template of every day; stored rows hold it as ``body``."""
    template = F.col("template" if "template" in logs.columns else "body").alias("template")
    per_day = logs.groupBy(F.to_date("timestamp").alias("day"), template).agg(F.count("*").alias("n"))
    return per_day.groupBy("day").agg(
        F.max_by("template", F.struct("n", "template")).alias("template"), F.max("n").alias("n")
    )


def risk_scores(logs: DataFrame, limit: float = Z_LIMIT) -> DataFrame:
    """Per service: error share, share of unusual hours, and their weighted sum."""
    hours = anomaly_scores(logs, "service_name").groupBy("service_name").agg(
        F.avg((F.coalesce(F.col("z"), F.lit(0.0)) > limit).cast("double")).alias("unusual")
    )
    errors = logs.groupBy("service_name").agg(
        F.avg((F.col("severity") == ERROR).cast("double")).alias("error_share")
    )
    return errors.join(hours, "service_name").select(
        "service_name",
        F.round("error_share", 6).alias("error_share"),
        F.round("unusual", 6).alias("unusual"),
        F.round(0.5 * F.col("error_share") + 0.5 * F.col("unusual"), 6).alias("risk"),
    )


def seasonal_baseline(logs: DataFrame, key: str = "service_name") -> DataFrame:
    """Expected rows per key and hour of day: the mean over the days seen."""
    days = logs.agg(F.count_distinct(F.to_date("timestamp"))).first()[0]
    return (
        logs.groupBy(key, F.hour("timestamp").alias("hour_of_day"))
        .agg(F.count("*").alias("n"))
        .select(key, "hour_of_day", F.round(F.col("n") / F.lit(max(days, 1)), 6).alias("expected"))
    )


def daily_trend(logs: DataFrame, key: str = "service_name", ahead: int = 1) -> DataFrame:
    """Least-squares line through daily counts, and its value ``ahead`` days after the last."""
    day_no = F.unix_date(F.to_date("timestamp")).alias("day_no")
    daily = logs.groupBy(key, day_no).agg(F.count("*").alias("n"))
    y, x = F.col("n"), F.col("day_no")
    fit = daily.groupBy(key).agg(
        F.regr_slope(y, x).alias("slope"),
        F.avg("n").alias("mean_n"),
        F.avg("day_no").alias("mean_day"),
        F.max("day_no").alias("last_day"),
    )
    value = F.col("mean_n") + F.col("slope") * (F.col("last_day") + ahead - F.col("mean_day"))
    return fit.select(
        key, F.round("slope", 6).alias("slope"), F.round(value, 4).alias("forecast")
    )


def _tier(age: Column) -> Column:
    return F.when(age > COLD_AFTER_DAYS, "cold").when(age > WARM_AFTER_DAYS, "warm").otherwise("hot")


def with_tier(logs: DataFrame, as_of: str) -> DataFrame:
    """Add ``tier`` by age: over a year cold, over thirty days warm, else hot."""
    return logs.withColumn("tier", _tier(F.datediff(F.lit(as_of).cast("date"), F.to_date("timestamp"))))


def write_tiers(logs: DataFrame, path: str, as_of: str) -> None:
    """Write all rows by tier and day, in place of what ``path`` held."""
    (
        with_tier(logs, as_of)
        .hint("rebalance", "tier", "log_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("tier", "log_date")
        .parquet(path)
    )


def move_tiers(spark: SparkSession, path: str, as_of: str) -> int:
    """Move the days that have crossed an age limit to their new tier; the number of days moved.

    Other days are not read. A day is written to its new place before its old folder goes, and one that
    an interrupted run left in both places is written once more from the old one.
    """
    if not path_exists(spark, path):
        return 0
    stored = spark.read.parquet(path)
    days = stored.select("tier", "log_date").distinct()
    age = F.datediff(F.lit(as_of).cast("date"), F.col("log_date"))
    moves = (
        days.withColumn("wanted", _tier(age)).filter("tier <> wanted").collect()
    )  # a row for each day that moves
    if not moves:
        return 0
    leaving = F.struct("tier", "log_date").isin(
        [F.struct(F.lit(m["tier"]).alias("tier"), F.lit(m["log_date"]).alias("log_date")) for m in moves]
    )
    with scratch_scope(spark):
        moved = materialise(stored.filter(leaving).withColumn("tier", _tier(age)), "moved")
        (
            moved.hint("rebalance", "tier", "log_date")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("tier", "log_date")
            .parquet(path)
        )
        for m in moves:
            remove_folder(spark, f"{path}/tier={m['tier']}/log_date={m['log_date']}")
    return len(moves)


def purge(logs: DataFrame, subjects: DataFrame, key: str) -> DataFrame:
    """Rows of subjects that did not ask to be forgotten."""
    wanted = broadcast_if_small(subjects.select(key).distinct())
    return logs.join(wanted, key, "left_anti")


def purge_table(logs: DataFrame, subjects: DataFrame, key: str, path: str) -> None:
    """Purge the table at ``path``, rewriting only the days of loads that hold rows to remove.

    The rows to keep are written to the shared folder first, so a lost executor cannot leave
    a day half read and half overwritten. Days left without rows lose their folder.
    """
    wanted = broadcast_if_small(subjects.select(key).distinct())
    by = [c for c in ("load_id", "log_date") if c in logs.columns]
    hit = logs.join(wanted, key, "left_semi").select(*by).distinct()
    days = {tuple(r) for r in hit.collect()}
    if not days:
        return
    touched = F.broadcast(logs.sparkSession.createDataFrame(sorted(days), hit.schema))  # a row per day
    spark = logs.sparkSession
    with scratch_scope(spark):
        kept = materialise(purge(logs.join(touched, by, "left_semi"), subjects, key), "purged")
        (
            kept.hint("rebalance", *by)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*by)
            .parquet(path)
        )
        for day in days - {tuple(r) for r in kept.select(*by).distinct().collect()}:
            folder = "/".join(f"{c}={v}" for c, v in zip(by, day, strict=True))
            remove_folder(spark, f"{path}/{folder}")
