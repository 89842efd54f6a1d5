"""Rules and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from cedarlog.operators import rules as r
from cedarlog.operators import scoring as s
from cedarlog.operators.induce import induce_rules
from cedarlog.registry.base import ORACLE, event_lines, query, with_feed, with_parsed
from cedarlog.plans.ingest import structure
from cedarlog.sources import feed

# Candidate patterns per service, in the order they are tried.
CANDIDATES = (
    ("parcel-router", 1, r"Parcel scanned at belt=b(?P<belt>\d+) grams=(?P<grams>[\d.]+)"),
    ("parcel-router", 2, r"(?P<verb>\w+) (?P<rest>.*)"),
    ("badge-gate", 1, r"(?P<broken>"),
    ("badge-gate", 2, r".*"),
    ("badge-gate", 3, r"Badge (?P<outcome>\w+) holder=(?P<holder>\w+) reader=(?P<reader>\S+)"),
    ("stock-index", 1, r"Shelf counted aisle=(?P<aisle>\w+) took=(?P<ms>\d+)ms"),
    ("kiosk-ui", 1, r"Screen shown /other/(?P<item>\d+)"),
    ("kiosk-ui", 2, r"Shown (?P<item>\d+)"),
    ("kiosk-ui", 3, r"Screen (?P<item>\d+)"),
    ("kiosk-ui", 4, r"Screen shown /item/(?P<item>\d+)"),
)


def _rules(spark):
    return spark.createDataFrame(list(CANDIDATES), "service_name string, attempt int, pattern string")


def _messages(spark, d):
    return feed.logs_view(spark, d).select("event_id", "service_name", F.col("message").alias("line"), "severity")


def _candidate_sql() -> str:
    """Each pattern with its groups unnamed; patterns that cannot count get NULL."""
    import re

    rows = []
    for service, attempt, pattern in CANDIDATES:
        usable = pattern not in (r"(?P<broken>", r".*")
        plain = "'^" + re.sub(r"\(\?P<\w+>", "(", pattern) + "'" if usable else "NULL"
        rows.append(f"('{service}', CAST({attempt} AS INTEGER), '{pattern}', CAST({plain} AS VARCHAR))")
    return "cand(service_name, attempt, pattern, plain) AS (VALUES " + ", ".join(rows) + ")"


_VERDICT = (
    f", {_candidate_sql()}, verdict AS (SELECT c.service_name, c.attempt, c.pattern,"
    " coalesce(bool_and(regexp_matches(l.message, c.plain)), false) AS ok"
    " FROM cand c LEFT JOIN logs l ON l.service_name = c.service_name GROUP BY ALL)"
)


@query("rule_validate", with_feed(_VERDICT + " SELECT service_name, attempt, pattern, ok FROM verdict"))
def rule_validate(spark, d):
    return r.validate_rules(_messages(spark, d), _rules(spark))


@query(
    "rule_select",
    with_feed(
        _VERDICT
        + """ SELECT s.service_name, v.pattern, CAST(v.attempt AS VARCHAR) AS attempt FROM (SELECT DISTINCT service_name FROM logs) s
        LEFT JOIN (SELECT * FROM verdict WHERE ok AND attempt <= 3
                   QUALIFY row_number() OVER (PARTITION BY service_name ORDER BY attempt) = 1) v
        ON v.service_name = s.service_name"""
    ),
)
def rule_select(spark, d):
    chosen = r.select_rules(_messages(spark, d), _rules(spark))
    return chosen.withColumn("attempt", F.col("attempt").cast("string"))


@query(
    "rule_apply",
    with_feed(
        """SELECT event_id,
        CASE WHEN template LIKE 'Parcel scanned%' THEN CAST(user_id AS VARCHAR) END AS belt,
        CASE WHEN service_name = 'badge-gate' THEN 'h' || user_id END AS holder,
        CASE WHEN template LIKE 'Parcel scanned%' THEN amount END AS grams,
        CASE WHEN service_name = 'stock-index' THEN CAST(k AS VARCHAR) END AS ms,
        CASE WHEN service_name = 'parcel-router' AND template NOT LIKE 'Parcel scanned%'
             THEN split_part(message, ' ', 1) END AS verb,
        CASE WHEN service_name = 'kiosk-ui' THEN CAST(k AS VARCHAR) END AS item FROM logs"""
    ),
)
def rule_apply(spark, d):
    done = r.apply_rules(_messages(spark, d), _rules(spark))
    get = lambda name: F.try_element_at("fields", F.lit(name)).alias(name)
    return done.select("event_id", *[get(n) for n in ("belt", "holder", "grams", "ms", "verb", "item")])


def _many_rules(spark):
    """The candidates among 600 rules of services that log nothing, and one that only another dialect takes."""
    more = [(f"quiet-{i}", 1, rf"(?P<n>line {i}) .*") for i in range(600)] + [("kiosk-ui", 0, r"(?P<w>Screen)(?(w) never|x)")]
    return _rules(spark).unionByName(spark.createDataFrame(more, "service_name string, attempt int, pattern string"))


@query("rule_validate_many", with_feed(_VERDICT + " SELECT service_name, attempt, pattern, ok FROM verdict"))
def rule_validate_many(spark, d):
    """Patterns as a column: what the candidates get is the same among very many rules."""
    done = r.validate_rules(_messages(spark, d), _many_rules(spark))
    return done.filter(~F.col("service_name").startswith("quiet-") & (F.col("attempt") > 0))


@query("rule_apply_many", ORACLE["rule_apply"])
def rule_apply_many(spark, d):
    done = r.apply_rules(_messages(spark, d), _many_rules(spark))
    get = lambda name: F.try_element_at("fields", F.lit(name)).alias(name)
    return done.select("event_id", *[get(n) for n in ("belt", "holder", "grams", "ms", "verb", "item")])


@query("induced_rules", with_feed("SELECT service_name, true AS ok, count(*) AS lines, count(*) AS matched FROM logs GROUP BY 1"))
def induced_rules(spark, d):
    """Patterns induced from the lines of each service: they pass the check and read every line."""
    lines = _messages(spark, d)
    rules = induce_rules(lines).filter("attempt = 1")
    checked = r.validate_rules(lines, rules).select("service_name", "ok")
    applied = r.apply_rules(lines, rules).groupBy("service_name").agg(F.count("*").alias("lines"), F.count("fields").alias("matched"))
    return checked.join(applied, "service_name").select("service_name", "ok", "lines", "matched")


@query(
    "sample_lines",
    with_feed(
        """SELECT service_name, message AS line FROM (SELECT DISTINCT service_name, message FROM logs)
        QUALIFY row_number() OVER (PARTITION BY service_name ORDER BY md5(message), message) <= 10"""
    ),
)
def sample_lines(spark, d):
    return r.sample_lines(_messages(spark, d))


@query(
    "drift_monitor",
    with_parsed(
        """SELECT file_name AS source_file, strftime(date_trunc('hour', event_ts), '%Y-%m-%d %H:%M:%S') AS period,
        count(*) AS n, CAST(count(parse_error) AS BIGINT) AS failed, round(count(parse_error) / count(*), 6) AS rate
        FROM parsed GROUP BY 1, 2 HAVING count(parse_error) / count(*) > 0.2"""
    ),
)
def drift_monitor(spark, d):
    rows = structure(event_lines(spark, d), feed.DEFAULT_YEAR, feed.INGEST_TS)
    found = r.drift(rows.withColumn("timestamp", F.col("event_ts")), 0.2, "source_file")
    return found.withColumn("period", F.date_format("period", "yyyy-MM-dd HH:mm:ss")).withColumn(
        "rate", F.round("rate", 6)
    )


@query(
    "score_regex",
    with_feed(
        """, p(id, pattern) AS (VALUES ('parcel-router', '^(\\w+) (.*)'), ('badge-gate', '^.*'),
                              ('stock-index', NULL), ('kiosk-ui', '^Screen shown /other')),
        v AS (SELECT id, bool_and(regexp_matches(message, pattern)) AS ok FROM p JOIN logs ON service_name = id GROUP BY 1)
        SELECT id, CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM v"""
    ),
)
def score_regex(spark, d):
    predictions = spark.createDataFrame(
        [("parcel-router", r"(?P<verb>\w+) (?P<rest>.*)"), ("badge-gate", ".*"), ("stock-index", "("),
         ("kiosk-ui", "Screen shown /other")],
        "id string, predicted string",
    )
    samples = _messages(spark, d).select(F.col("service_name").alias("id"), "line")
    return s.regex_scores(samples, predictions)


def _golden(spark, d):
    """Each text against a prediction that differs in layout, in content, or is empty."""
    conv = feed.table(spark, d, "conversations")
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    golden = conv.select(key.alias("id"), F.col("text").alias("expected"))
    spaced = F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("\n ")))
    predicted = (
        F.when(F.col("turn") % 3 == 0, spaced)
        .when(F.col("turn") % 3 == 1, F.concat("text", F.lit(" x")))
        .otherwise("")
    )
    return golden, conv.select(key.alias("id"), predicted.alias("predicted"))


_SQL_SCORE = """SELECT conv_id || '-' || turn AS id,
  CASE WHEN turn % 3 = 0 AND text <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM conversations"""


@query("score_sql", _SQL_SCORE)
def score_sql(spark, d):
    golden, predicted = _golden(spark, d)
    return s.evaluate(golden, predicted, s.sql_score).select("id", "score")


_PAIRS = """pairs AS (SELECT a.conv_id, a.turn, a.text AS predicted, b.text AS expected
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1),
sets AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(predicted), '\\s+'), lambda t: t <> '')) AS p,
  list_distinct(list_filter(string_split_regex(lower(expected), '\\s+'), lambda t: t <> '')) AS e FROM pairs),
scored AS (SELECT conv_id, turn, CASE WHEN len(p) = 0 OR len(e) = 0 THEN 0.0 ELSE
  len(list_intersect(p, e)) / len(list_distinct(list_concat(p, e))) END AS raw FROM sets)"""


def _answers(spark, d):
    """Each message scored against the one before it in its conversation."""
    conv = feed.table(spark, d, "conversations")
    before = conv.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("expected"))
    both = conv.join(before, ["conv_id", "turn"])
    return both.select("conv_id", "turn", s.answer_score(F.col("text"), F.col("expected")).alias("score"))


@query("score_jaccard", f"WITH {_PAIRS} SELECT conv_id, turn, round(raw, 6) AS score FROM scored")
def score_jaccard(spark, d):
    return _answers(spark, d).withColumn("score", F.round("score", 6))


@query("eval_mean", f"WITH {_PAIRS} SELECT count(*) AS items, round(avg(raw), 6) AS mean FROM scored")
def eval_mean(spark, d):
    return s.mean_score(_answers(spark, d))


@query(
    "eval_compare",
    f"""WITH {_PAIRS}, first AS ({_SQL_SCORE}), m AS (SELECT (SELECT avg(score) FROM first) AS a, (SELECT avg(raw) FROM scored) AS b)
    SELECT round(a, 6) AS first_mean, round(b, 6) AS second_mean, round(a - b, 6) AS difference,
    CASE WHEN a - b > 0.1 THEN 'first' WHEN a - b < -0.1 THEN 'second' ELSE 'equal' END AS verdict FROM m""",
)
def eval_compare(spark, d):
    golden, predicted = _golden(spark, d)
    return s.compare_runs(s.evaluate(golden, predicted, s.sql_score), _answers(spark, d))
