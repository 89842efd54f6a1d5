"""Parsing, masking, context: queries over lines and texts made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cedarlog.functions.context import kv_context, promote_attributes
from cedarlog.functions.mask import leaks, mask_json, mask_text
from cedarlog.functions.parse import iso_time, parse_lines
from cedarlog.functions.variants import PROMOTED_KEYS, fields_of, texts_of, worthwhile
from cedarlog.operators.stitch import is_head, stitch
from cedarlog.plans.ingest import quarantine, structure, with_signatures
from cedarlog.registry.base import (
    event_lines,
    query,
    sql_mask,
    sql_stamp,
    stamp,
    with_feed,
    with_parsed,
)
from cedarlog.session import materialise
from cedarlog.sources import feed


def structured(spark, d):
    return structure(event_lines(spark, d), feed.DEFAULT_YEAR, feed.INGEST_TS)


@query(
    "parse_roundtrip",
    with_parsed(
        f"""SELECT event_id, format, {sql_stamp('ts')} AS ts, severity, service_name, message,
        environment, app_id, department, host, region, parse_error FROM parsed"""
    ),
)
def parse_roundtrip(spark, d):
    return structured(spark, d).select(
        "event_id", "format", stamp().alias("ts"), "severity", "service_name", "message",
        "environment", "app_id", "department", "host", "region", "parse_error",
    )


@query(
    "parse_formats_count",
    with_parsed("SELECT format, format <> 'fallback' AS ts_ok, count(*) AS n FROM parsed GROUP BY ALL"),
)
def parse_formats_count(spark, d):
    return structured(spark, d).groupBy("format", "ts_ok").agg(F.count("*").alias("n"))


@query(
    "parse_quarantine",
    with_parsed(
        """SELECT CASE WHEN parse_error IS NULL THEN 'good' ELSE 'quarantine' END AS sink,
        count(*) AS n FROM parsed GROUP BY 1"""
    ),
)
def parse_quarantine(spark, d):
    # Stored first, so that the two sinks do not both parse the lines.
    good, bad = quarantine(materialise(structured(spark, d).select("event_id", "parse_error"), "structured"))
    part = lambda df, name: df.select(F.lit(name).alias("sink"))
    return part(good, "good").unionByName(part(bad, "quarantine")).groupBy("sink").agg(
        F.count("*").alias("n")
    )


@query(
    "parse_to_log_table",
    with_parsed(
        """SELECT service_name, severity, strftime(ts, '%Y-%m-%d') AS log_date, file_name AS source_file,
        count(*) AS n, CAST(count(host) AS BIGINT) AS hosts FROM parsed GROUP BY ALL"""
    ),
)
def parse_to_log_table(spark, d):
    rows = with_signatures(structured(spark, d))
    return rows.groupBy(
        "service_name", "severity", F.date_format("log_date", "yyyy-MM-dd").alias("log_date"),
        F.get_json_object("context", "$.source_file").alias("source_file"),
    ).agg(F.count("*").alias("n"), F.count("host").alias("hosts"))


# JSON lines in which fields are missing, empty, null, zero or under their other name.
_JSON_LINE_SQL = """
SELECT event_id,
  CASE event_type WHEN 'view' THEN 'INFO' WHEN 'click' THEN 'DEBUG' ELSE severity END AS severity,
  CASE event_type WHEN 'purchase' THEN 'unknown' ELSE service_name END AS service_name,
  CASE WHEN event_type = 'signup' THEN 'k' || k ELSE 'm' || k END AS body,
  {ts} AS ts, event_type <> 'purchase' AS ts_ok
FROM feed
""".format(ts="CASE WHEN event_type = 'purchase' THEN '2024-02-01 00:00:00' ELSE " + sql_stamp("ts") + " END")


@query("parse_json_fields", with_feed(_JSON_LINE_SQL))
def parse_json_fields(spark, d):
    e = feed.event_logs(spark, d)
    t = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    kind, k = F.col("event_type"), F.col("k").cast("string")
    line = (
        F.when(
            kind == "view",
            F.concat(F.lit('{"level":"","severity":null,"service":0,"app":'), q(F.col("service_name")),
                     F.lit(',"time":'), q(t), F.lit(',"msg":'), q(F.concat(F.lit("m"), k)), F.lit("}")),
        )
        .when(
            kind == "click",
            F.concat(F.lit('{"level":"DEBUG","severity":[],"service":'), q(F.col("service_name")),
                     F.lit(',"timestamp":false,"date":'), q(F.concat(t, F.lit("+00:00"))),
                     F.lit(',"message":{},"msg":'), q(F.concat(F.lit("m"), k)), F.lit("}")),
        )
        .when(
            kind == "purchase",
            F.concat(F.lit('{"severity":'), q(F.col("severity")), F.lit(',"timestamp":"2024","message":'),
                     q(F.concat(F.lit("m"), k)), F.lit("}")),
        )
        .otherwise(
            F.concat(F.lit('{"severity":'), q(F.col("severity")), F.lit(',"level":"TRACE","service":'),
                     q(F.col("service_name")), F.lit(',"timestamp":'), q(F.concat(t, F.lit("Z"))),
                     F.lit(',"message":'),
                     q(F.concat(F.when(kind == "signup", "k").otherwise("m"), k)), F.lit("}")),
        )
    )
    return parse_lines(
        e.select("event_id", line.alias("value")), feed.DEFAULT_YEAR, feed.INGEST_TS
    ).select("event_id", "severity", "service_name", "body", stamp().alias("ts"), "ts_ok")


@query(
    "time_normalise",
    with_feed(
        f"""SELECT event_id, {sql_stamp('ts')} AS zulu,
        {sql_stamp("ts - INTERVAL 2 HOUR")} AS shifted, {sql_stamp('ts')} AS naive,
        {sql_stamp("date_trunc('day', ts)")} AS day, CAST(NULL AS VARCHAR) AS bad FROM feed"""
    ),
)
def time_normalise(spark, d):
    t = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    return feed.event_logs(spark, d).select(
        "event_id",
        stamp(iso_time(F.concat(t, F.lit("Z")))).alias("zulu"),
        stamp(iso_time(F.concat(t, F.lit("+02:00")))).alias("shifted"),
        stamp(iso_time(F.replace(t, F.lit("T"), F.lit(" ")))).alias("naive"),
        stamp(iso_time(F.date_format("timestamp", "yyyyMMdd"))).alias("day"),
        stamp(iso_time(F.date_format("timestamp", "yyyy"))).alias("bad"),
    )


@query(
    "multiline_stitch",
    with_feed(
        f"""SELECT service_name AS file, count(*) OVER (PARTITION BY service_name ORDER BY event_id) AS record,
        CASE WHEN severity = 'ERROR' THEN 1 + k % 3 ELSE 0 END + 1 AS n_lines,
        {sql_stamp('ts')} || ' ' || severity || ' ' || service_name || ': ' || template
        || CASE WHEN severity = 'ERROR' THEN
             array_to_string([chr(10) || '  at frame ' || i FOR i IN range(0, 1 + k % 3)], '') ELSE '' END AS value
        FROM feed"""
    ),
)
def multiline_stitch(spark, d):
    """Errors carry a stack of one to three more lines; files are cut into blocks of an hour."""
    e = feed.logs_view(spark, d).withColumn(
        "k", F.get_json_object("context", "$.latency_ms").cast("bigint")
    )
    head = F.concat(stamp(), F.lit(" "), "severity", F.lit(" "), "service_name", F.lit(": "), "body")
    frames = F.when(
        F.col("severity") == "ERROR",
        F.transform(F.sequence(F.lit(0), F.col("k") % 3),
                    lambda i: F.concat(F.lit("  at frame "), i.cast("string"))),
    ).otherwise(F.array().cast("array<string>"))
    lines = e.select(
        F.col("service_name").alias("source_file"),
        F.unix_timestamp(F.date_trunc("hour", "timestamp")).alias("block"),
        "event_id",
        F.posexplode(F.concat(F.array(head), frames)).alias("i", "value"),
    ).withColumn("line_id", F.struct("event_id", "i"))
    return stitch(lines, is_head(F.col("value"))).select(
        F.col("source_file").alias("file"), "record", "value", "n_lines"
    )


@query("mask_documents", f"SELECT doc_id, {sql_mask('text')} AS text FROM documents")
def mask_documents(spark, d):
    return feed.table(spark, d, "documents").select("doc_id", mask_text(F.col("text")).alias("text"))


@query("mask_pages", f"SELECT page_id, {sql_mask('html')} AS html FROM pages")
def mask_pages(spark, d):
    return feed.table(spark, d, "pages").select("page_id", mask_text(F.col("html")).alias("html"))


@query("mask_conversations", f"SELECT conv_id, turn, {sql_mask('text')} AS text FROM conversations")
def mask_conversations(spark, d):
    return feed.table(spark, d, "conversations").select(
        "conv_id", "turn", mask_text(F.col("text")).alias("text")
    )


@query(
    "mask_leak_check",
    f"""WITH t AS (SELECT 'documents' AS src, text FROM documents UNION ALL SELECT 'pages', html FROM pages
        UNION ALL SELECT 'conversations', text FROM conversations)
        SELECT src, count(*) AS n, CAST(count(*) FILTER (WHERE {sql_mask('text')} <> text) AS BIGINT) AS masked,
        CAST(0 AS BIGINT) AS leaking FROM t GROUP BY src""",
)
def mask_leak_check(spark, d):
    texts = (
        feed.table(spark, d, "documents").select(F.lit("documents").alias("src"), "text")
        .unionByName(feed.table(spark, d, "pages").select(F.lit("pages").alias("src"), F.col("html").alias("text")))
        .unionByName(feed.table(spark, d, "conversations").select(F.lit("conversations").alias("src"), "text"))
    ).withColumn("safe", mask_text(F.col("text")))
    return texts.groupBy("src").agg(
        F.count("*").alias("n"),
        F.sum((F.col("safe") != F.col("text")).cast("bigint")).alias("masked"),
        F.sum(leaks(F.col("safe")).cast("bigint")).alias("leaking"),
    )


@query(
    "mask_context",
    with_feed(
        """SELECT event_id, '<EMAIL_REDACTED>' AS mail, '<IP_REDACTED>' AS addr, '443' AS port,
        'card <CC_REDACTED>' AS tag, ip AS kept, CAST(k AS VARCHAR) AS n, amount AS amount FROM feed"""
    ),
)
def mask_context_query(spark, d):
    e = feed.event_logs(spark, d)
    text = F.to_json(
        F.struct(
            F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("mail"),
            F.struct(F.struct(F.col("client_ip").alias("addr"), F.lit(443).alias("port")).alias("peer")).alias("net"),
            F.array(F.concat(F.lit("card 4111-1111-1111-"), (F.col("k") + 1000).cast("string"))).alias("tags"),
            F.array(F.struct(F.col("client_ip").alias("ip"))).alias("hops"),
            F.col("k").alias("n"),
            F.col("value").cast("decimal(14,2)").cast("string").alias("amount"),
        )
    )
    safe = mask_json(F.parse_json("raw"), texts_of(F.col("raw")))
    get = lambda path: F.get_json_object("safe", path)
    return e.select("event_id", text.alias("raw")).select("event_id", safe.alias("safe")).select(
        "event_id", get("$.mail").alias("mail"), get("$.net.peer.addr").alias("addr"),
        get("$.net.peer.port").alias("port"), get("$.tags[0]").alias("tag"),
        get("$.hops[0].ip").alias("kept"), get("$.n").alias("n"), get("$.amount").alias("amount"),
    )


@query(
    "kv_context",
    with_parsed(
        """, bodies AS (SELECT event_id, message || ' a=' || event_id || ' a=b=' || event_id || ' =x y=' AS m
                       FROM parsed),
        words AS (SELECT event_id, unnest(string_split(m, ' ')) AS w, generate_subscripts(string_split(m, ' '), 1) AS i
                  FROM bodies),
        kv AS (SELECT event_id, i, split_part(w, '=', 1) AS key, substr(w, strpos(w, '=') + 1) AS value
               FROM words WHERE contains(w, '=')),
        last AS (SELECT *, row_number() OVER (PARTITION BY event_id, key ORDER BY i DESC) AS r FROM kv)
        SELECT event_id, key, value FROM last WHERE r = 1"""
    ),
)
def kv_context_query(spark, d):
    e = structured(spark, d)
    n = F.col("event_id").cast("string")
    body = F.concat("message", F.lit(" a="), n, F.lit(" a=b="), n, F.lit(" =x y="))
    return e.select("event_id", F.explode(kv_context(body)).alias("key", "value"))


@query(
    "promote_attributes",
    with_feed(
        """SELECT event_id, CASE WHEN k % 2 = 0 THEN 'qa' ELSE 'prod' END AS environment,
        CASE WHEN event_type = 'view' THEN department ELSE service_name END AS department,
        host, CASE WHEN event_type = 'click' THEN NULL ELSE region END AS region, CAST(NULL AS VARCHAR) AS app_id
        FROM feed"""
    ),
)
def promote_attributes_query(spark, d):
    e = feed.event_logs(spark, d)
    kind = F.col("event_type")
    text = F.to_json(
        F.struct(
            F.when(F.col("k") % 2 == 0, "qa").otherwise("").alias("environment"),
            F.lit("prod").alias("env"),
            F.when(kind != "view", F.col("service_name")).alias("department"),
            F.col("department").alias("dept"),
            "host",
            F.when(kind == "click", "").otherwise(F.col("region")).alias("region"),
            F.lit(0).alias("app_id"),
        )
    )
    js, texts = F.parse_json("raw"), texts_of(F.col("raw"))
    clean = e.select("event_id", text.alias("raw")).select(
        "event_id", fields_of(F.to_json(worthwhile(js, texts)), PROMOTED_KEYS).alias("fields")
    )
    found = promote_attributes(F.col("fields"))
    return clean.select("event_id", *[c.alias(n) for n, c in found.items()])
