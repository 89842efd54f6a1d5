"""Whole jobs with files in and out, as batch and as stream, in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cedarlog.plans.ingest import bulk_load, load_templates, save_next, structure
from cedarlog.plans.knowledge import index_logs
from cedarlog.operators.history import move_tiers, purge_table, top_template, write_tiers
from cedarlog.operators.queries import failing_endpoints
from cedarlog.operators.templates import cluster_count, mine_templates, new_patterns, template_stats
from cedarlog.registry.base import event_lines, query, sql_stamp, stamp, with_feed, with_parsed
from cedarlog.session import materialise, scratch_path
from cedarlog.sources import feed, tables
from cedarlog.sources.lines import stream_lines
from cedarlog.streaming.ingest import dual_sink, evolve_templates, start_ingest, streaming_error_rate
from cedarlog.streaming.late import late_rows, period_counts, start_counting
from cedarlog.streaming.stitch import open_records, stitch_stream, stream_parts
from cedarlog.streaming.templates import compact_signatures, track_templates, tracked_templates


def _land(spark, d, name: str) -> str:
    """The event feed written as text files, as a landing zone would hold them."""
    folder = scratch_path(spark, name)
    event_lines(spark, d).select("value").write.text(folder)
    return folder


_COUNTS = """SELECT service_name, severity, strftime(ts, '%Y-%m-%d') AS log_date, count(*) AS n,
  CAST(count(host) AS BIGINT) AS hosts FROM parsed GROUP BY ALL"""


def _counts(rows):
    return rows.groupBy(
        "service_name", "severity", F.date_format("log_date", "yyyy-MM-dd").alias("log_date")
    ).agg(F.count("*").alias("n"), F.count("host").alias("hosts"))


@query("bulk_load", with_parsed(_COUNTS))
def bulk_load_query(spark, d):
    """Text files to the stored table with mined templates, then read back."""
    out = scratch_path(spark, "bulk")
    bulk_load(
        spark, _land(spark, d, "zone"), f"{out}/logs", f"{out}/templates", feed.DEFAULT_YEAR,
        feed.INGEST_TS, glob="*.txt",
    )
    return _counts(tables.read_logs(spark, f"{out}/logs"))


#: What mining makes of each line: the layout adds words to the message, of which some vary.
_STORED = """, stored AS (SELECT p.event_id, p.ts, p.service_name,
  CASE p.format WHEN 'standard' THEN f.template || ' env=prod <*> <*> <*> dept=' || f.department || ' app_id=' || f.app_id
    WHEN 'syslog' THEN f.template || ' env=prod <*> <*>' WHEN 'nginx' THEN 'GET <*> HTTP/1.1 <*>'
    WHEN 'fallback' THEN 'unreadable entry <*>' ELSE f.template END AS template
  FROM parsed p JOIN feed f USING (event_id))"""


@query("bulk_load_templates", with_parsed(_STORED + " SELECT template, count(*) AS size FROM stored GROUP BY 1"))
def bulk_load_templates(spark, d):
    out = scratch_path(spark, "bulk")
    bulk_load(
        spark, _land(spark, d, "zone"), f"{out}/logs", f"{out}/templates", feed.DEFAULT_YEAR,
        feed.INGEST_TS, glob="*.txt",
    )
    return load_templates(spark, f"{out}/templates").select("template", "size")


@query("stream_ingest", with_parsed(_COUNTS))
def stream_ingest(spark, d):
    """The same files as a stream, with both sinks; result of the log sink."""
    out = scratch_path(spark, "stream")
    job = start_ingest(
        stream_lines(spark, _land(spark, d, "zone"), "*.txt", files_per_batch=4),
        f"{out}/logs", f"{out}/state", feed.DEFAULT_YEAR, feed.INGEST_TS, f"{out}/documents",
    )
    job.awaitTermination()
    return _counts(spark.read.parquet(f"{out}/logs"))


@query("stream_documents", "SELECT count(*) AS n FROM events")
def stream_documents(spark, d):
    """Documents in the second sink: one for each log row."""
    out = scratch_path(spark, "stream")
    job = start_ingest(
        stream_lines(spark, _land(spark, d, "zone"), "*.txt"),
        f"{out}/logs", f"{out}/state", feed.DEFAULT_YEAR, feed.INGEST_TS, f"{out}/documents",
    )
    job.awaitTermination()
    return spark.read.parquet(f"{out}/documents").agg(F.count("*").alias("n"))


def _message_stream(spark, d, out: str, files: int):
    feed.logs_view(spark, d).select("message").repartition(12).write.parquet(f"{out}/messages")
    return spark.readStream.schema("message string").option("maxFilesPerTrigger", files).parquet(f"{out}/messages")


_MINED = with_feed("SELECT template, count(*) AS size FROM logs GROUP BY template")


@query("stream_templates", _MINED)
def stream_templates(spark, d):
    """Templates kept as state by signature over three micro-batches and a restart; the same as mining all rows at once."""
    out = scratch_path(spark, "evolve")
    source = _message_stream(spark, d, out, 4)
    for _ in range(2):
        track_templates(source, f"{out}/signatures", f"{out}/state").awaitTermination()
    return tracked_templates(spark, f"{out}/signatures").select("template", "size")


@query("stream_templates_compacted", _MINED)
def stream_templates_compacted(spark, d):
    """The same with signatures that can retire, and with the folders of old micro-batches brought together."""
    out = scratch_path(spark, "evolve")
    track_templates(_message_stream(spark, d, out, 3), f"{out}/signatures", f"{out}/state", retire_after="1 day").awaitTermination()
    compact_signatures(spark, f"{out}/signatures")
    return tracked_templates(spark, f"{out}/signatures").select("template", "size")


@query("stream_versions")
def stream_versions(spark, d):
    """Templates that are mined anew with each micro-batch of parsed lines, from those known before; the newest set."""
    out = scratch_path(spark, "evolve")
    lines = stream_lines(spark, _land(spark, d, "zone"), "*.txt", files_per_batch=4)
    job = (
        structure(lines, feed.DEFAULT_YEAR, feed.INGEST_TS)
        .writeStream.option("checkpointLocation", f"{out}/state")
        .foreachBatch(evolve_templates(f"{out}/templates", f"{out}/logs"))
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    return load_templates(spark, f"{out}/templates").select("template", "size")


@query(
    "stream_stitch",
    with_feed(
        f"""SELECT service_name AS log, CASE WHEN severity = 'ERROR' THEN 1 + k % 3 ELSE 0 END + 1 AS n_lines,
        {sql_stamp('ts')} || ' ' || severity || ' ' || service_name || ': ' || template
        || CASE WHEN severity = 'ERROR' THEN
             array_to_string([chr(10) || '  at frame ' || i FOR i IN range(0, 1 + k % 3)], '') ELSE '' END AS value
        FROM feed"""
    ),
)
def stream_stitch(spark, d):
    """Four files for each service; the last trace of a file goes on in the next, which another micro-batch reads."""
    out = scratch_path(spark, "stitch")
    e = feed.logs_view(spark, d).withColumn("k", F.get_json_object("context", "$.latency_ms").cast("bigint"))
    head = F.concat(stamp(), F.lit(" "), "severity", F.lit(" "), "service_name", F.lit(": "), "body")
    frames = F.when(
        F.col("severity") == "ERROR",
        F.transform(F.sequence(F.lit(0), F.col("k") % 3), lambda i: F.concat(F.lit("  at frame "), i.cast("string"))),
    ).otherwise(F.array().cast("array<string>"))
    top = e.agg(F.max("event_id")).first()[0] + 1
    lines = e.select(
        F.col("service_name").alias("log"), "event_id", F.floor(F.col("event_id") * 4 / top).alias("file"),
        F.posexplode(F.concat(F.array(head), frames)).alias("i", "value"),
    )
    ends = lines.groupBy("log", "file").agg(F.max("event_id").alias("end"))
    cut = lines.join(ends, ["log", "file"]).withColumn("file", F.col("file") + ((F.col("event_id") == F.col("end")) & (F.col("i") > 0)).cast("int"))
    cut = materialise(cut, "lines")
    for f in range(5):
        part = cut.filter(F.col("file") == f).repartition("log").sortWithinPartitions("log", "event_id", "i")
        part.select("log", "value").write.partitionBy("log").text(f"{out}/zone/{f}")
    source = stream_parts(spark, f"{out}/zone/*/*", "*.txt", files_per_batch=6)

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/records/batch={batch_id}")

    records = stitch_stream(source, log=F.regexp_extract("path", "log=([^/]+)/", 1))
    records.writeStream.option("checkpointLocation", f"{out}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    closed = spark.read.parquet(f"{out}/records").select("log", "value", "n_lines")
    return closed.unionByName(open_records(spark, f"{out}/state").select("log", "value", "n_lines"))


@query(
    "stream_error_rate",
    with_feed(
        f"""SELECT {sql_stamp("date_trunc('hour', ts)")} AS period, count(*) AS n,
        CAST(count(*) FILTER (WHERE severity = 'ERROR') AS BIGINT) AS errors FROM logs GROUP BY 1"""
    ),
)
def stream_error_rate(spark, d):
    """Hourly error counts of a stream; complete mode, so the last open hours are in it too."""
    out = scratch_path(spark, "rate")
    feed.logs_view(spark, d).select("timestamp", "severity").write.parquet(f"{out}/in")
    source = spark.readStream.schema("timestamp timestamp, severity string").parquet(f"{out}/in")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/rates")

    job = (
        streaming_error_rate(source)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", f"{out}/state")
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    return spark.read.parquet(f"{out}/rates").select(stamp("period").alias("period"), "n", "errors")


@query(
    "stream_late_rows",
    with_feed(
        f"""SELECT b % 4 AS source, {sql_stamp("date_trunc('hour', ts)")} AS hour, CAST(count(*) FILTER (WHERE NOT late) AS BIGINT) AS counted,
        CAST(count(*) FILTER (WHERE late) AS BIGINT) AS late
        FROM (SELECT *, coalesce(date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM feed f WHERE f.event_id % 4 < l.b) - INTERVAL 3 DAY, false) AS late
              FROM (SELECT ts, event_id % 4 AS b FROM feed) l) GROUP BY 1, 2 HAVING count(*) FILTER (WHERE late) > 0"""
    ),
)
def stream_late_rows(spark, d):
    """Four micro-batches that each reach over the whole time, so all but the last days of the later ones come too late."""
    out = scratch_path(spark, "late")
    rows = feed.logs_view(spark, d).select("timestamp", "severity", (F.col("event_id") % 4).alias("b"))
    rows = materialise(rows, "rows")
    for b in range(4):
        rows.filter(F.col("b") == b).coalesce(1).write.mode("append").parquet(f"{out}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    start_counting(source, f"{out}/counts", f"{out}/state", "3 days", source="b").awaitTermination()
    behind = late_rows(spark, f"{out}/counts").select(F.col("source").cast("bigint").alias("source"), "hour", F.col("n").alias("late"))
    held = rows.groupBy(F.col("b").alias("source"), F.date_trunc("hour", "timestamp").alias("hour")).agg(F.count("*").alias("n"))
    joined = held.join(behind, ["source", "hour"])
    return joined.select("source", stamp("hour").alias("hour"), (F.col("n") - F.col("late")).alias("counted"), "late")


@query(
    "stream_late_counts",
    with_feed(
        f"""SELECT {sql_stamp("date_trunc('hour', ts)")} AS period, count(*) AS n, CAST(count(*) FILTER (WHERE severity = 'ERROR') AS BIGINT) AS errors,
        date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM feed) - INTERVAL 1 HOUR AS closed FROM feed GROUP BY ALL"""
    ),
)
def stream_late_counts(spark, d):
    """Hourly counts of a stream in the order of time: nothing is late, and all but the last hours are closed."""
    out = scratch_path(spark, "counts")
    rows = materialise(feed.logs_view(spark, d).select("timestamp", "severity"), "rows")
    low, high = rows.agg(F.min("timestamp"), F.max("timestamp")).first()
    for k in range(3):
        share = F.floor((F.unix_timestamp("timestamp") - F.lit(low.timestamp())) * 3 / F.lit(high.timestamp() - low.timestamp() + 1))
        rows.filter(share == k).coalesce(1).write.mode("append").parquet(f"{out}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in").withColumn("source_file", F.lit("feed"))
    start_counting(source, f"{out}/counts", f"{out}/state").awaitTermination()
    return period_counts(spark, f"{out}/counts").select(stamp("period").alias("period"), "n", "errors", "closed")


#: Event numbers of one file, which one task writes in order.
FILE = 200_000


def _write_files(lines, last: int, folder: str) -> None:
    """Lines in the order of their events as files that each hold the same events however far the writing got.

    A service rotates a file that has grown full, so no file and no task grows with the input.
    """
    number = F.floor(F.col("event_id") / FILE).cast("int")
    dealt = lines.repartitionById(last // FILE + 1, number).sortWithinPartitions("event_id")
    dealt.select("value").write.text(folder)


@query("bulk_load_rotated", with_parsed(_COUNTS))
def bulk_load_rotated(spark, d):
    """Half of the lines are loaded, then the files are found again under other names, the last one longer: each line once."""
    out = scratch_path(spark, "rotated")
    lines = materialise(event_lines(spark, d).select("event_id", "value"), "lines")
    last = lines.agg(F.max("event_id")).first()[0]
    for name, part in (("before", lines.filter(F.col("event_id") <= last // 2)), ("after", lines)):
        _write_files(part, last, f"{out}/{name}")
        bulk_load(
            spark, f"{out}/{name}", f"{out}/logs", f"{out}/templates", feed.DEFAULT_YEAR, feed.INGEST_TS,
            glob="*.txt", ledger_path=f"{out}/ledger",
        )
    return _counts(tables.read_logs(spark, f"{out}/logs"))


@query(
    "bulk_load_quarantine",
    with_parsed(
        """SELECT CASE WHEN parse_error IS NULL THEN 'logs' ELSE 'quarantine' END AS store, count(*) AS n, min(message) AS least FROM parsed GROUP BY 1"""
    ),
)
def bulk_load_quarantine(spark, d):
    """Rows that could not be read lie apart from the others after a load."""
    out = scratch_path(spark, "bulk")
    bulk_load(
        spark, _land(spark, d, "zone"), f"{out}/logs", f"{out}/templates", feed.DEFAULT_YEAR, feed.INGEST_TS,
        glob="*.txt", quarantine_path=f"{out}/quarantine",
    )
    stores = tables.read_logs(spark, f"{out}/logs").select(F.lit("logs").alias("store"), "message").unionByName(
        spark.read.parquet(f"{out}/quarantine").select(F.lit("quarantine").alias("store"), "message"))
    return stores.groupBy("store").agg(F.count("*").alias("n"), F.min("message").alias("least"))


@query(
    "bulk_load_multiline",
    with_feed(
        """SELECT service_name, severity, count(*) AS n, CAST(sum(CASE WHEN severity = 'ERROR' THEN 1 + k % 3 ELSE 0 END) AS BIGINT) AS frames
        FROM feed GROUP BY ALL"""
    ),
)
def bulk_load_multiline(spark, d):
    """Errors carry a stack of one to three more lines; records are stitched before they are parsed."""
    out = scratch_path(spark, "bulk")
    e = feed.logs_view(spark, d).withColumn("k", F.get_json_object("context", "$.latency_ms").cast("int"))
    head = F.concat(stamp(), F.lit(" "), "severity", F.lit(" "), "service_name", F.lit(": "), "body")
    stack = F.when(F.col("severity") == "ERROR", F.expr("repeat('\n  at some frame', 1 + k % 3)")).otherwise("")
    e.select(F.concat(head, stack).alias("value")).write.text(f"{out}/zone")
    bulk_load(
        spark, f"{out}/zone", f"{out}/logs", f"{out}/templates", feed.DEFAULT_YEAR, feed.INGEST_TS, glob="*.txt", multiline=True,
    )
    frames = F.sum(F.size(F.split("message", "at some frame")) - 1)
    return tables.read_logs(spark, f"{out}/logs").groupBy("service_name", "severity").agg(F.count("*").alias("n"), frames.alias("frames"))


@query("staged_history", with_feed("SELECT strftime(ts, '%Y-%m-%d') AS log_date, count(*) AS n FROM logs GROUP BY 1"))
def staged_history(spark, d):
    """History staged by year and day, loaded in one go."""
    out = scratch_path(spark, "staged")
    tables.write_logs_by_year(feed.logs_view(spark, d), out)
    staged = spark.read.parquet(out)
    return staged.groupBy(F.date_format("log_date", "yyyy-MM-dd").alias("log_date")).agg(F.count("*").alias("n"))


@query("tiered_store", with_feed("SELECT CASE WHEN DATE '2024-02-10' - log_date > 30 THEN 'warm' ELSE 'hot' END AS tier, count(*) AS n FROM logs GROUP BY 1"))
def tiered_store(spark, d):
    out = scratch_path(spark, "tiers")
    write_tiers(feed.logs_view(spark, d), out, "2024-01-12")
    for as_of in ("2024-01-20", "2024-02-10", "2024-02-10"):
        move_tiers(spark, out, as_of)
    return spark.read.parquet(out).groupBy("tier").agg(F.count("*").alias("n"))


@query(
    "purge_stored",
    with_feed(
        """SELECT host, count(*) AS n FROM logs WHERE host NOT IN
        (SELECT 'server-' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') FROM nation) GROUP BY 1"""
    ),
)
def purge_stored(spark, d):
    """Hosts numbered like a nation asked to be forgotten; only days that hold them are rewritten."""
    out = scratch_path(spark, "purge")
    tables.write_logs(feed.logs_view(spark, d), out)
    asked = feed.table(spark, d, "nation").select(
        F.concat(F.lit("server-"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("host")
    )
    purge_table(spark.read.parquet(out), asked, "host", out)
    return spark.read.parquet(out).groupBy("host").agg(F.count("*").alias("n"))


@query(
    "batch_and_stream_share_logs",
    with_feed("SELECT service_name, severity, count(*) AS n FROM logs GROUP BY ALL"),
)
def batch_and_stream_share_logs(spark, d):
    """Half of the rows arrive as a batch, half as stream batches, one of them twice; one table."""
    out = scratch_path(spark, "shared")
    rows = feed.logs_view(spark, d)
    tables.write_logs(rows.filter("event_id % 2 = 0"), out)
    write = dual_sink(out)
    for i in (0, 1, 1):
        write(rows.filter(f"event_id % 4 = {2 * i + 1}"), i)
    return tables.read_logs(spark, out).groupBy("service_name", "severity").agg(F.count("*").alias("n"))


def _stored(spark, d):
    """The ``logs`` table after a bulk load of the event feed from text files."""
    out = scratch_path(spark, "stored")
    bulk_load(
        spark, _land(spark, d, "zone"), f"{out}/logs", f"{out}/templates", feed.DEFAULT_YEAR,
        feed.INGEST_TS, glob="*.txt",
    )
    return tables.read_logs(spark, f"{out}/logs"), load_templates(spark, f"{out}/templates")


@query(
    "stored_failing_endpoints",
    with_parsed(
        """SELECT '/item/' || k AS endpoint, count(*) AS n FROM feed WHERE format = 'nginx' AND status >= 500
        GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5"""
    ),
)
def stored_failing_endpoints(spark, d):
    logs, _ = _stored(spark, d)
    return failing_endpoints(logs.filter("service_name = 'nginx'"))


@query(
    "stored_templates",
    "SELECT count(*) AS n, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS unlike, CAST(0 AS BIGINT) AS unknown FROM events",
)
def stored_templates(spark, d):
    """Every stored row fits its template, every template is in the saved set, and the sizes add up."""
    logs, saved = _stored(spark, d)
    words, pattern = F.split("message", " "), F.split("body", " ")
    fits = F.forall(F.arrays_zip(words.alias("w"), pattern.alias("p")), lambda x: x["p"].isin("<*>") | (x["p"] == x["w"]))
    rows = logs.select(
        F.col("body").isNull().cast("long").alias("missing"), (~F.coalesce(fits, F.lit(False))).cast("long").alias("unlike")
    ).agg(F.sum("missing").alias("missing"), F.sum("unlike").alias("unlike"))
    size = saved.agg(F.sum("size")).first()[0]
    unknown = new_patterns(logs, saved).count()
    return rows.select(F.lit(size).alias("n"), "missing", "unlike", F.lit(unknown).cast("long").alias("unknown"))


@query(
    "stored_template_stats",
    with_parsed(
        _STORED + f""" SELECT template, count(*) AS n, {sql_stamp("min(ts)")} AS first_seen, {sql_stamp("max(ts)")} AS last_seen,
        count(DISTINCT service_name) AS services FROM stored GROUP BY 1"""
    ),
)
def stored_template_stats(spark, d):
    """Statistics of every template of a stored table."""
    logs, _ = _stored(spark, d)
    return template_stats(logs).select(
        "template", "n", stamp("first_seen").alias("first_seen"), stamp("last_seen").alias("last_seen"), "services"
    )


@query(
    "stored_top_template",
    with_parsed(
        _STORED + """ SELECT strftime(ts, '%Y-%m-%d') AS day, template, count(*) AS n FROM stored GROUP BY 1, 2
        QUALIFY row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY count(*) DESC, template DESC) = 1"""
    ),
)
def stored_top_template(spark, d):
    """The most frequent template of every day of a stored table."""
    logs, _ = _stored(spark, d)
    return top_template(logs).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "template", "n")


@query(
    "catalog_csv",
    """SELECT n_name AS department, CASE WHEN s_acctbal < 0 THEN 'High' ELSE 'Low' END AS criticality, count(*) AS systems,
    min(s_name) AS first_system FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2""",
)
def catalog_csv(spark, d):
    """A catalog of systems from a CSV file with a header, found again by SQL under its name."""
    out = scratch_path(spark, "catalog")
    systems = feed.table(spark, d, "supplier").join(feed.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    systems.select(
        F.col("s_name").alias("system_name"), F.col("n_name").alias("department"), F.lit("o@x.example").alias("owner_email"),
        F.when(F.col("s_acctbal") < 0, "High").otherwise("Low").alias("criticality"),
    ).write.option("header", True).csv(out)
    tables.read_catalog(spark, out)
    return tables.run_sql(
        spark, "SELECT department, criticality, count(*) AS systems, min(system_name) AS first_system FROM system_catalog GROUP BY ALL"
    )


@query("golden_set", "SELECT CAST(item_id AS VARCHAR) AS id, text AS query, CAST(length(text) AS VARCHAR) AS expected_answer FROM benchmark")
def golden_set(spark, d):
    """A golden set written as one JSON array of objects, as such sets are kept, and read with its schema."""
    out = scratch_path(spark, "golden")
    item = F.to_json(F.struct(
        F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"), F.length("text").cast("string").alias("expected_answer")))
    items = feed.table(spark, d, "benchmark").agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("value"))
    items.write.text(out)
    return tables.read_golden(spark, out, T.StructType.fromDDL("id string, query string, expected_answer string"))


@query("template_count", with_feed("SELECT count(DISTINCT template) AS n FROM logs"))
def template_count(spark, d):
    """How many templates the messages have."""
    found = mine_templates(feed.logs_view(spark, d))
    return spark.range(1).select(F.lit(cluster_count(found)).cast("bigint").alias("n"))


@query("templates_resumed", with_feed("SELECT template, md5(template) AS template_id, count(*) AS size FROM logs GROUP BY 1"))
def templates_resumed(spark, d):
    """Templates mined from the first half and saved, loaded again as seeds for the second half: same texts, ids and sizes."""
    out, rows = scratch_path(spark, "resumed"), feed.logs_view(spark, d)
    save_next(mine_templates(rows.filter("event_id % 2 = 0")), out)
    return mine_templates(rows.filter("event_id % 2 = 1"), seeds=load_templates(spark, out)).select("template", "template_id", "size")


@query("templates_strict", with_feed("SELECT template, count(*) AS size FROM logs GROUP BY 1"))
def templates_strict(spark, d):
    """With the highest threshold only words with digits may vary."""
    return mine_templates(feed.logs_view(spark, d), similarity=1.0).select("template", "size")


@query("chat_append", "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS sessions FROM conversations GROUP BY 1")
def chat_append(spark, d):
    out = scratch_path(spark, "chat")
    conv = feed.table(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), "role", F.col("text").alias("content")
    )
    tables.append_chat(conv, out)
    return tables.read_chat(spark, out).groupBy("role").agg(
        F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions")
    )


@query("index_logs", with_feed("SELECT service_name, count(*) AS n FROM logs GROUP BY 1"))
def index_logs_query(spark, d):
    """All log rows as stored documents with vectors."""
    out = scratch_path(spark, "kb")
    index_logs(feed.logs_view(spark, d), out)
    service = F.try_element_at("metadata", F.lit("service_name")).alias("service_name")
    return tables.read_documents(spark, out).groupBy(service).agg(F.count("*").alias("n"))
