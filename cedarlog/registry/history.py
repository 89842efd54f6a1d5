"""Jobs over history."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cedarlog.operators import baseline as bl
from cedarlog.operators import episodes as ep
from cedarlog.operators import forecast as fc
from cedarlog.operators import forget as fg
from cedarlog.operators import history as h
from cedarlog.operators import retrieval as rt
from cedarlog.operators.templates import with_signature_template
from cedarlog.registry.base import query, sql_stamp, stamp, with_feed
from cedarlog.session import materialise, scratch_path
from cedarlog.sources import feed, tables


def _logs(spark, d):
    return with_signature_template(feed.logs_view(spark, d))


_SCORES = """, hourly AS (SELECT service_name, date_trunc('hour', ts) AS hour, count(*) AS n FROM logs GROUP BY 1, 2),
scored AS (SELECT *, avg(n) OVER w AS mean, stddev_samp(n) OVER w AS dev FROM hourly
  WINDOW w AS (PARTITION BY service_name ORDER BY hour RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND INTERVAL 1 SECOND PRECEDING)),
z AS (SELECT *, CASE WHEN dev > 0 THEN (n - mean) / dev END AS z FROM scored)"""


@query(
    "anomaly_scores",
    with_feed(_SCORES + f" SELECT service_name, {sql_stamp('hour')} AS hour, n, round(z, 4) AS z FROM z"),
)
def anomaly_scores(spark, d):
    return h.anomaly_scores(_logs(spark, d), "service_name").select(
        "service_name", stamp("hour").alias("hour"), "n", F.round("z", 4).alias("z")
    )


@query(
    "anomaly_zscore",
    with_feed(_SCORES + f" SELECT service_name, {sql_stamp('hour')} AS hour, n FROM z WHERE z > 2.0"),
)
def anomaly_zscore(spark, d):
    return h.anomalies(_logs(spark, d), "service_name", limit=2.0).select(
        "service_name", stamp("hour").alias("hour"), "n"
    )


@query(
    "noise_filter",
    with_feed(
        """, noisy AS (SELECT template FROM logs WHERE severity = 'INFO' GROUP BY 1
                      HAVING count(*) > 0.12 * (SELECT count(*) FROM logs))
        SELECT template, severity, count(*) AS n FROM logs
        WHERE NOT (severity = 'INFO' AND template IN (SELECT template FROM noisy)) GROUP BY 1, 2"""
    ),
)
def noise_filter(spark, d):
    kept = h.without_noise(_logs(spark, d), 0.12)
    return kept.groupBy("template", "severity").agg(F.count("*").alias("n"))


@query(
    "correlate_traces",
    with_feed(
        f""", tr AS (SELECT *, strftime(ts, '%Y%m%d%H') || '-' || host AS tid FROM logs WHERE severity = 'ERROR')
        SELECT tid AS trace_id, count(*) AS errors, {sql_stamp('min(ts)')} AS first_seen, {sql_stamp('max(ts)')} AS last_seen,
        string_agg(DISTINCT service_name, ',' ORDER BY service_name) AS services, count(DISTINCT service_name) AS n_services
        FROM tr GROUP BY 1 HAVING count(DISTINCT service_name) >= 1"""
    ),
)
def correlate_traces(spark, d):
    rows = _logs(spark, d).withColumn(
        "trace_id", F.concat_ws("-", F.date_format("timestamp", "yyyyMMddHH"), "host")
    )
    return h.correlated_traces(rows, 1).withColumn("first_seen", stamp("first_seen")).withColumn(
        "last_seen", stamp("last_seen")
    )


@query(
    "correlate_services",
    with_feed(
        """, tr AS (SELECT *, strftime(ts, '%Y%m%d%H') AS tid FROM logs WHERE severity = 'ERROR')
        SELECT tid AS trace_id, count(*) AS errors, string_agg(DISTINCT service_name, ',' ORDER BY service_name) AS services
        FROM tr GROUP BY 1 HAVING count(DISTINCT service_name) >= 3"""
    ),
)
def correlate_services(spark, d):
    rows = _logs(spark, d).withColumn("trace_id", F.date_format("timestamp", "yyyyMMddHH"))
    return h.correlated_traces(rows, 3).select("trace_id", "errors", "services")


@query(
    "correlate_interval",
    with_feed(
        """SELECT a.region, count(DISTINCT a.event_id) AS n_first, count(b.event_id) AS pairs FROM logs a
        LEFT JOIN logs b ON b.region = a.region AND b.severity = 'ERROR' AND b.service_name = 'parcel-router'
          AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 5 MINUTE
        WHERE a.severity = 'ERROR' AND a.service_name = 'badge-gate' GROUP BY 1"""
    ),
)
def correlate_interval(spark, d):
    """Payment errors that follow an auth error in the same region within five minutes."""
    bad = F.col("severity") == "ERROR"
    return h.followed_by(
        _logs(spark, d), bad & (F.col("service_name") == "badge-gate"),
        bad & (F.col("service_name") == "parcel-router"), "region",
    )


@query(
    "incident_sessions",
    with_feed(
        f""", e AS (SELECT service_name, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY service_name ORDER BY ts) <= INTERVAL 30 MINUTE
               THEN 0 ELSE 1 END AS s FROM logs WHERE severity = 'ERROR'),
        g AS (SELECT *, sum(s) OVER (PARTITION BY service_name ORDER BY ts ROWS UNBOUNDED PRECEDING) AS incident FROM e)
        SELECT service_name, CAST(incident AS BIGINT) AS incident, {sql_stamp('min(ts)')} AS started, {sql_stamp('max(ts)')} AS ended,
        count(*) AS errors FROM g GROUP BY 1, 2"""
    ),
)
def incident_sessions(spark, d):
    return h.incidents(_logs(spark, d), "service_name", 30).withColumn("started", stamp("started")).withColumn(
        "ended", stamp("ended")
    )


@query(
    "period_rollup",
    with_feed(
        f"""SELECT strftime(log_date, '%Y-%m-%d') AS day, service_name, count(*) AS n,
        CAST(count(*) FILTER (WHERE severity = 'ERROR') AS BIGINT) AS errors, {sql_stamp('min(ts)')} AS first_seen,
        {sql_stamp('max(ts)')} AS last_seen FROM logs GROUP BY ROLLUP (log_date, service_name)"""
    ),
)
def period_rollup(spark, d):
    return h.period_report(_logs(spark, d)).select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "service_name", "n", "errors",
        stamp("first_seen").alias("first_seen"), stamp("last_seen").alias("last_seen"),
    )


@query(
    "top_template_daily",
    with_feed(
        """SELECT strftime(log_date, '%Y-%m-%d') AS day, template, count(*) AS n FROM logs GROUP BY log_date, template
        QUALIFY row_number() OVER (PARTITION BY log_date ORDER BY count(*) DESC, template DESC) = 1"""
    ),
)
def top_template_daily(spark, d):
    return h.top_template(_logs(spark, d)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "risk_score",
    with_feed(
        _SCORES
        + """, u AS (SELECT service_name, avg(CASE WHEN z > 3.0 THEN 1.0 ELSE 0.0 END) AS unusual FROM z GROUP BY 1),
        e AS (SELECT service_name, avg(CASE WHEN severity = 'ERROR' THEN 1.0 ELSE 0.0 END) AS error_share FROM logs GROUP BY 1)
        SELECT service_name, round(error_share, 6) AS error_share, round(unusual, 6) AS unusual,
        round(0.5 * error_share + 0.5 * unusual, 6) AS risk FROM e JOIN u USING (service_name)"""
    ),
)
def risk_score(spark, d):
    return h.risk_scores(_logs(spark, d))


@query(
    "seasonal_baseline",
    with_feed(
        """SELECT service_name, CAST(hour(ts) AS INTEGER) AS hour_of_day,
        round(count(*) / (SELECT count(DISTINCT log_date) FROM logs), 6) AS expected FROM logs GROUP BY 1, 2"""
    ),
)
def seasonal_baseline(spark, d):
    return h.seasonal_baseline(_logs(spark, d))


@query(
    "daily_trend",
    with_feed(
        """, daily AS (SELECT service_name, CAST(log_date - DATE '1970-01-01' AS BIGINT) AS x, count(*) AS n FROM logs GROUP BY 1, 2),
        f AS (SELECT service_name, regr_slope(n, x) AS slope, avg(n) AS mn, avg(x) AS mx, max(x) AS last FROM daily GROUP BY 1)
        SELECT service_name, round(slope, 6) AS slope, round(mn + slope * (last + 1 - mx), 4) AS forecast FROM f"""
    ),
)
def daily_trend(spark, d):
    return h.daily_trend(_logs(spark, d))


@query(
    "tier_assign",
    with_feed(
        """SELECT CASE WHEN DATE '2025-01-10' - log_date > 365 THEN 'cold' WHEN DATE '2025-01-10' - log_date > 30 THEN 'warm'
        ELSE 'hot' END AS tier, count(*) AS n FROM logs GROUP BY 1"""
    ),
)
def tier_assign(spark, d):
    return h.with_tier(_logs(spark, d), "2025-01-10").groupBy("tier").agg(F.count("*").alias("n"))


@query(
    "purge_subject",
    """SELECT user_id, count(*) AS n FROM events
    WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1""",
)
def purge_subject(spark, d):
    asked = feed.table(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"))
    return h.purge(feed.event_logs(spark, d), asked, "user_id").groupBy("user_id").agg(F.count("*").alias("n"))


@query("categorise_kmeans")
def categorise_kmeans(spark, d):
    """Documents grouped by their word-hash vectors; fixed seed."""
    docs = rt.embed(feed.table(spark, d, "documents").select("doc_id", "text"), "text", 64)
    # Stored, so that training and placing do not both read and split the texts.
    held = materialise(docs.select("doc_id", "embedding"), "vectors")
    vectors = held.select("doc_id", array_to_vector("embedding").alias("features"))
    model = KMeans(k=8, seed=7, maxIter=5, featuresCol="features", predictionCol="category").fit(vectors)
    return model.transform(vectors).groupBy("category").agg(F.count("*").alias("n"))


_SERIES = """, hourly AS (SELECT service_name, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hr, count(*) AS n FROM logs GROUP BY 1, 2),
hrs AS (SELECT s.service_name, g.hr, coalesce(hourly.n, 0) AS n, (g.hr + 72) % 168 AS hour_of_week
  FROM (SELECT DISTINCT service_name FROM hourly) s CROSS JOIN
  (SELECT unnest(generate_series((SELECT min(hr) FROM hourly), (SELECT max(hr) FROM hourly))) AS hr) g
  LEFT JOIN hourly ON hourly.service_name = s.service_name AND hourly.hr = g.hr)"""
_NORMAL = _SERIES + """, prof AS (SELECT service_name, hour_of_week, CAST(quantile_disc(n, 0.25) AS DOUBLE) AS lo,
  CAST(quantile_disc(n, 0.5) AS DOUBLE) AS median, CAST(quantile_disc(n, 0.75) AS DOUBLE) AS hi FROM hrs GROUP BY 1, 2),
scored AS (SELECT hrs.*, median, greatest((hi - lo) / 1.349, sqrt(median), 1.0) AS spread, (n - median) / greatest((hi - lo) / 1.349, sqrt(median), 1.0) AS score
  FROM hrs JOIN prof USING (service_name, hour_of_week))"""


def _normal(spark, d):
    """Hours scored against the merged profiles of two loads."""
    counted = bl.hours(feed.logs_view(spark, d))
    path = scratch_path(spark, "profiles")
    for i in range(2):
        bl.save_profile(bl.profile(counted.filter(f"at % 2 = {i}")), path, f"load-{i}")
    return bl.robust_scores(counted, bl.read_profile(spark, path))


@query(
    "normal_scores",
    with_feed(_NORMAL + " SELECT service_name, hr AS hour_no, CAST(n AS BIGINT) AS n, median, round(spread, 6) AS spread, round(score, 6) AS score FROM scored"),
)
def normal_scores(spark, d):
    return _normal(spark, d).select(
        "service_name", F.col("at").alias("hour_no"), "n", "median", F.round("spread", 6).alias("spread"), F.round("score", 6).alias("score")
    )


@query(
    "change_points",
    "WITH RECURSIVE "
    + with_feed(
        _NORMAL
        + f""", r AS (SELECT service_name, hr, score, row_number() OVER (PARTITION BY service_name ORDER BY hr) AS i FROM scored),
        w AS (SELECT service_name, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS hr, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS down, CAST(0 AS BIGINT) AS uf, CAST(0 AS BIGINT) AS df, 0 AS alarm,
                CAST(0 AS BIGINT) AS began FROM (SELECT DISTINCT service_name FROM r)
          UNION ALL
          SELECT service_name, i, hr, CASE WHEN hit <> 0 THEN 0 ELSE rise END, CASE WHEN hit <> 0 THEN 0 ELSE fall END, uf, df, hit, CASE WHEN hit = 1 THEN uf ELSE df END
          FROM (SELECT *, CASE WHEN rise > {bl.ALARM} THEN 1 WHEN fall > {bl.ALARM} THEN -1 ELSE 0 END AS hit FROM (
            SELECT r.service_name, r.i, r.hr, greatest(0.0, w.up + r.score - {bl.DRIFT}) AS rise, greatest(0.0, w.down - r.score - {bl.DRIFT}) AS fall,
              CASE WHEN w.up = 0 AND w.up + r.score - {bl.DRIFT} > 0 THEN r.hr ELSE w.uf END AS uf,
              CASE WHEN w.down = 0 AND w.down - r.score - {bl.DRIFT} > 0 THEN r.hr ELSE w.df END AS df
            FROM w JOIN r ON r.service_name = w.service_name AND r.i = w.i + 1)))
        SELECT service_name, strftime(make_timestamp(began * 3600000000), '%Y-%m-%d %H:%M:%S') AS began,
          strftime(make_timestamp(hr * 3600000000), '%Y-%m-%d %H:%M:%S') AS noticed, CAST(alarm AS INTEGER) AS direction FROM w WHERE alarm <> 0"""
    ).removeprefix("WITH "),
)
def change_points(spark, d):
    """Lasting shifts of each service against its profile."""
    found = bl.change_points(_normal(spark, d))
    return found.select("service_name", stamp("began").alias("began"), stamp("noticed").alias("noticed"), "direction")


@query(
    "frequent_episodes",
    with_feed(
        """, e AS (SELECT strftime(ts, '%Y%m%d%H') AS t, service_name AS s, row_number() OVER (PARTITION BY strftime(ts, '%Y%m%d%H') ORDER BY ts, service_name) AS i
          FROM logs WHERE severity = 'ERROR'),
        p AS (SELECT s AS episode, 1 AS length, t FROM e
          UNION ALL SELECT a.s || '>' || b.s, 2, t FROM e a JOIN e b USING (t) WHERE a.i < b.i
          UNION ALL SELECT a.s || '>' || b.s || '>' || c.s, 3, t FROM e a JOIN e b USING (t) JOIN e c USING (t) WHERE a.i < b.i AND b.i < c.i)
        SELECT episode, CAST(length AS INTEGER) AS length, count(DISTINCT t) AS support FROM p GROUP BY 1, 2 HAVING count(DISTINCT t) >= 3"""
    ),
)
def frequent_episodes(spark, d):
    """Services that fail after each other within an hour, in at least three hours."""
    logs = feed.logs_view(spark, d).withColumn("trace_id", F.date_format("timestamp", "yyyyMMddHH"))
    return ep.frequent_episodes(logs, 3, 3).withColumn("episode", F.array_join("episode", ">"))


@query("hourly_series", with_feed(_SERIES + " SELECT service_name, hr AS hour_no, CAST(n AS BIGINT) AS n FROM hrs"))
def hourly_series(spark, d):
    """Rows per service and hour, hours without rows too."""
    return fc.series(feed.logs_view(spark, d), "service_name").withColumnRenamed("at", "hour_no")


@query("forecast_season")
def forecast_season(spark, d):
    """The next day of every service by hour, with a daily season."""
    return fc.forecast(feed.logs_view(spark, d))


@query("forecast_back_test")
def forecast_back_test(spark, d):
    """Errors of the forecast of the last day, made before it."""
    return fc.back_test(feed.logs_view(spark, d))


@query(
    "forget_subject",
    with_feed(
        """SELECT host, count(*) AS n FROM logs WHERE host NOT IN
        (SELECT 'server-' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') FROM nation) GROUP BY 1"""
    ),
)
def forget_subject(spark, d):
    """Hosts numbered like a nation asked to be forgotten; only days whose filter may hold one are opened."""
    out, folder = scratch_path(spark, "forget"), ["load_id", "log_date"]
    tables.write_logs(feed.logs_view(spark, d), f"{out}/logs", "first")
    fg.update_filters(spark, f"{out}/logs", f"{out}/filters", folder)
    asked = feed.table(spark, d, "nation").select(
        F.concat(F.lit("SERVER-"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("token")
    )
    fg.forget(spark, f"{out}/logs", f"{out}/filters", asked, folder)
    return spark.read.parquet(f"{out}/logs").groupBy("host").agg(F.count("*").alias("n"))
