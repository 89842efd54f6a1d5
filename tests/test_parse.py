from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cedarlog.functions.parse import parse_lines
from cedarlog.plans.ingest import quarantine, structure, suspicious_time, with_signatures

NOW = "2025-12-01 00:00:00"


def parse(spark, *lines, year=2025):
    df = spark.createDataFrame([(i, l) for i, l in enumerate(lines)], "i int, value string")
    return parse_lines(df, year, NOW).orderBy("i").collect()


def load(spark, *lines, source=None):
    df = spark.createDataFrame(
        [(i, l, source) for i, l in enumerate(lines)], "i int, value string, source_file string"
    )
    return structure(df, 2025, NOW)


def test_standard_with_and_without_colon(spark):
    rows = parse(
        spark,
        "2025-11-24 10:00:00 INFO auth-service: User logged in",
        "2025-11-24 10:00:00 INFO auth-service User logged in",
        "  2025-11-24 10:00:00 INFO auth-service: User logged in\t",
    )
    for r in rows:
        assert (r.format, r.severity, r.service_name, r.body) == (
            "standard", "INFO", "auth-service", "User logged in",
        )
        assert r.timestamp == datetime(2025, 11, 24, 10) and r.ts_ok and r.context is None


def test_json(spark):
    (r,) = load(
        spark,
        '{"timestamp":"2025-11-24T10:00:00Z","level":"ERROR","service":"pay","message":"Declined","user_id":123}',
    ).select("*", F.get_json_object("context", "$.user_id").alias("user")).collect()
    assert (r.format, r.severity, r.service_name, r.message, r.user) == (
        "json", "ERROR", "pay", "Declined", "123",
    )
    assert r.timestamp == datetime(2025, 11, 24, 10) and r.parse_error is None


def test_json_falsy_values_fall_through(spark):
    rows = parse(
        spark,
        "{}",
        '{"level":"","severity":null}',
        '{"severity":0,"level":"WARN","service":[],"app":"a","message":{},"msg":"m"}',
        '{"severity":"0","message":"false"}',
        '{"severity":0.0,"message":" "}',
    )
    assert [(r.severity, r.service_name, r.body) for r in rows] == [
        ("INFO", "unknown", "{}"),
        ("INFO", "unknown", '{"level":"","severity":null}'),
        ("WARN", "a", "m"),
        ("0", "unknown", "false"),
        ("INFO", "unknown", " "),
    ]


def test_json_values_of_other_types_are_kept_and_marked(spark):
    rows = parse(spark, '{"level":30,"message":"m"}', '{"level":"x","message":"m","n":3}')
    assert [(r.severity, r.parse_error) for r in rows] == [("30", "type_coerced"), ("x", None)]


def test_broken_json_is_fallback(spark):
    rows = parse(spark, '{"bad"', '{"a":1} x', '{"a":1, a}', '{"a":1}{"b":2}')
    assert [(r.format, r.parse_error) for r in rows] == [
        ("fallback", "format_unknown"),
        ("fallback", "format_unknown"),
        ("fallback", "json_strict"),
        ("fallback", "json_strict"),
    ]


def test_json_with_repeated_keys_and_no_numbers(spark):
    rows = parse(
        spark,
        '{"level":"WARN","service":"a","message":"m","n":1,"n":2}',
        '{"level":"WARN","level":"ERROR","service":"a","message":"x NaN, y","v":[NaN,-Infinity, 1]}',
        '{"message":"q \\" NaN,","v":NaN}',
        '{"message":5,"message":"six"}',
    )
    assert [(r.format, r.severity, r.service_name, r.body, r.parse_error) for r in rows] == [
        ("json", "WARN", "a", "m", None),
        ("json", "ERROR", "a", "x NaN, y", None),
        ("json", "INFO", "unknown", 'q " NaN,', None),
        ("json", "INFO", "unknown", "six", None),
    ]


def test_syslog(spark):
    rows = parse(
        spark,
        "Nov 24 16:00:00 web-1 sshd[1234]: Accepted key",
        "Nov  4 16:00:00 web-1 sshd: Accepted key",
    )
    assert [(r.format, r.severity, r.service_name, r.body) for r in rows] == [
        ("syslog", "INFO", "sshd", "Accepted key")
    ] * 2
    assert rows[0].context == {"host": "web-1"}
    assert [r.timestamp for r in rows] == [datetime(2025, 11, 24, 16), datetime(2025, 11, 4, 16)]


def test_leap_day_needs_a_leap_year(spark):
    (bad,) = parse(spark, "Feb 29 10:00:00 h s: m")
    (good,) = parse(spark, "Feb 29 10:00:00 h s: m", year=2024)
    assert not bad.ts_ok and bad.timestamp == datetime(2025, 12, 1)
    assert good.ts_ok and good.timestamp == datetime(2024, 2, 29, 10)


def test_access_log(spark):
    rows = parse(
        spark,
        '1.2.3.4 - - [24/Nov/2025:16:00:00 +0200] "GET /x HTTP/1.1" 200 12',
        '1.2.3.4 - - [24/Nov/2025:16:00:00 +02:00] "GET /x HTTP/1.1" 200 12 "-" "agent"',
        '1.2.3.4 - - [nonsense] "GET /x HTTP/1.1" 200 12',
    )
    for r in rows:
        assert (r.format, r.service_name, r.severity, r.body) == (
            "nginx", "nginx", "INFO", "GET /x HTTP/1.1 200",
        )
        assert r.context == {"client_ip": "1.2.3.4", "status": "200", "bytes": "12"}
    assert [r.timestamp for r in rows[:2]] == [datetime(2025, 11, 24, 14)] * 2
    assert not rows[2].ts_ok


@pytest.mark.parametrize(
    "line",
    [
        "some free text",
        "2025-11-24 10:00:00.123 INFO svc: m",
        "2025-11-24T10:00:00 INFO svc: m",
        "[2023-10-27T10:05:00] [INFO] [payment] Processing order",
    ],
)
def test_fallback(spark, line):
    (r,) = parse(spark, line)
    assert (r.format, r.severity, r.service_name, r.body, r.parse_error) == (
        "fallback", "UNKNOWN", "unknown", line, "format_unknown",
    )
    assert not r.ts_ok and r.timestamp == datetime(2025, 12, 1)


def test_blank_lines_are_dropped_and_words_may_have_accents(spark):
    rows = parse(spark, "", "   ", " ", "2025-11-24 10:00:00 INFO sérvice: m")
    assert [r.service_name for r in rows] == ["sérvice"]


def test_context_only_where_the_layout_gave_none(spark):
    rows = load(
        spark,
        "2025-11-24 10:00:00 INFO s: a=1 b=2=3 a=9 x env=prod dept=infra",
        "Nov 24 16:00:00 web-1 s: a=1",
        '{"message":"q=1 region=eu"}',
        "{}",
        source="f.log",
    ).orderBy("i").collect()
    assert rows[0].context == '{"a":"9","b":"2=3","dept":"infra","env":"prod","source_file":"f.log"}'
    assert (rows[0].environment, rows[0].department) == ("prod", "infra")
    assert rows[1].context == '{"host":"web-1","source_file":"f.log"}' and rows[1].host == "web-1"
    assert rows[2].context == '{"message":"q=1 region=eu","source_file":"f.log"}'
    assert rows[2].region is None
    assert rows[3].context == '{"source_file":"f.log"}'


def test_promotion_falls_through_and_marks_other_types(spark):
    rows = load(
        spark,
        '{"environment":"","env":"qa","department":null,"dept":"x"}',
        '{"region":5,"host":0,"app_id":false}',
    ).orderBy("i").collect()
    assert (rows[0].environment, rows[0].department, rows[0].parse_error) == ("qa", "x", None)
    assert (rows[1].region, rows[1].host, rows[1].app_id) == ("5", None, None)
    assert rows[1].parse_error == "type_coerced"


def test_source_file_key_in_a_line_cannot_hide_the_file(spark):
    (r,) = load(spark, '{"message":"m","source_file":"fake"}', source="real.log").collect()
    assert r.source_file == "real.log"
    assert r.context.count("source_file") == 1 and "real.log" in r.context


def test_filter_on_parsed_column_does_not_parse_twice(spark):
    df = load(spark, "2025-11-24 10:00:00 INFO s: m")
    uses = lambda x: x._jdf.queryExecution().optimizedPlan().toString().count("parseJson")
    assert uses(df.filter("severity = 'ERROR' and host = 'h'")) == uses(df)


def test_quarantine_splits_all_rows(spark):
    good, bad = quarantine(load(spark, "2025-11-24 10:00:00 INFO s: m", "junk", '{"level":1}'))
    assert (good.count(), bad.count()) == (2, 1)  # a number in place of a text was read


def test_guessed_years_can_be_found(spark):
    df = load(spark, "Jan 01 10:00:00 h s: m", "Nov 24 10:00:00 h s: m")
    assert df.filter(suspicious_time(NOW)).count() == 1


def test_log_table_has_the_stored_columns(spark):
    from cedarlog.schema import LOG_TABLE

    df = with_signatures(load(spark, "2025-11-24 10:00:00 INFO s: took 5 ms"))
    assert df.columns == LOG_TABLE.fieldNames()
    r = df.first()
    assert r.body == "took <*> ms" and r.params == ["5"] and r.message == "took 5 ms"


def test_columns_that_nobody_reads_are_not_computed(spark):
    rows = load(spark, "2025-11-24 10:00:00 INFO auth-service: User logged in user=1", source="a.log")
    plan = rows.select("i", "message")._jdf.queryExecution().optimizedPlan().toString()
    assert "trace_id" not in plan and "yyyy-MM-dd HH:mm:ss" not in plan


def test_the_sinks_of_a_load_are_told_apart_after_one_parse(spark, monkeypatch):
    from cedarlog.registry import parsing

    parsed = []
    monkeypatch.setattr(parsing, "materialise", lambda df, name: parsed.append(name) or df.limit(1_000_000))
    assert parsing.parse_quarantine(spark, "/root/testdata/sf0.001").count() == 2
    assert parsed == ["structured"]
