"""Template queries over the messages of the event feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from cedarlog.operators.templates import (
    assign_signatures,
    assign_templates,
    mine_templates,
    new_patterns,
    signature,
    template_stats,
    with_signature_template,
)
from cedarlog.registry.base import query, sql_stamp, stamp, with_feed
from cedarlog.sources import feed


@query(
    "signature_templates",
    with_feed("SELECT event_id, template, md5(template) AS template_id FROM logs"),
)
def signature_templates(spark, d):
    return with_signature_template(feed.logs_view(spark, d)).select("event_id", "template", "template_id")


@query(
    "signature_documents",
    """SELECT doc_id, array_to_string(list_transform(string_split(text, ' '),
       lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END), ' ') AS template FROM documents""",
)
def signature_documents(spark, d):
    return feed.table(spark, d, "documents").select("doc_id", signature(F.col("text")).alias("template"))


@query(
    "template_stats",
    with_feed(
        f"""SELECT template, md5(template) AS template_id, count(*) AS n, {sql_stamp('min(ts)')} AS first_seen,
        {sql_stamp('max(ts)')} AS last_seen, count(DISTINCT service_name) AS services FROM logs GROUP BY template"""
    ),
)
def template_stats_query(spark, d):
    return template_stats(with_signature_template(feed.logs_view(spark, d))).select(
        "template", "template_id", "n", stamp("first_seen").alias("first_seen"),
        stamp("last_seen").alias("last_seen"), "services",
    )


@query(
    "template_params",
    with_feed(
        """SELECT event_id, template,
        array_to_string(list_filter(string_split(message, ' '), lambda t: regexp_matches(t, '[0-9]')), '|') AS params FROM logs"""
    ),
)
def template_params(spark, d):
    """What stands at the wildcards of each row's template."""
    rows = with_signature_template(feed.logs_view(spark, d))
    return rows.select("event_id", "template", F.array_join("params", "|").alias("params"))


@query(
    "new_patterns",
    with_feed(
        """SELECT template, count(*) AS n FROM logs WHERE log_date >= DATE '2024-01-15'
        AND template NOT IN (SELECT template FROM logs WHERE severity <> 'WARN' AND log_date < DATE '2024-01-15')
        GROUP BY template"""
    ),
)
def new_patterns_query(spark, d):
    rows = with_signature_template(feed.logs_view(spark, d))
    known = rows.filter((F.col("severity") != "WARN") & (F.col("log_date") < "2024-01-15"))
    return new_patterns(rows.filter(F.col("log_date") >= "2024-01-15"), known).select("template", "n")


@query(
    "mine_templates",
    with_feed("SELECT template, count(*) AS size FROM logs GROUP BY template"),
)
def mine_templates_query(spark, d):
    return mine_templates(feed.logs_view(spark, d)).select("template", "size")


@query(
    "mine_templates_words",
    with_feed(
        """SELECT 'Request <*> handled by <*> in <*>' AS template, count(*) AS size,
        CAST(sum(k) AS BIGINT) AS total FROM feed"""
    ),
)
def mine_templates_words(spark, d):
    """Words without digits vary too, so similarity decides; then every row gets its template."""
    e = feed.event_logs(spark, d)
    text = F.concat(
        F.lit("Request "), "event_type", F.lit(" handled by "), "service_name", F.lit(" in "),
        F.col("k").cast("string"), F.lit("ms"),
    )
    rows = e.select(text.alias("message"), "k")
    done = assign_templates(rows, assign_signatures(rows))
    number = F.regexp_extract(F.col("params")[2], r"(\d+)", 1).cast("bigint")
    return done.groupBy("template").agg(F.count("*").alias("size"), F.sum(number).alias("total"))


@query("mine_templates_documents")
def mine_templates_documents(spark, d):
    """Every line of every document; no SQL twin, the tests hold its invariants."""
    lines = feed.table(spark, d, "documents").select(
        F.explode(F.split("text", "\n")).alias("message")
    ).filter(F.length(F.trim("message")) > 0)
    return mine_templates(lines)
