import gzip
import json

import pytest
from pyspark.sql import functions as F

from cedarlog import schema
from cedarlog.operators.history import purge_table
from cedarlog.operators.stitch import is_head, stitch
from cedarlog.plans.ingest import bulk_load, load_templates, structure, with_signatures
from cedarlog.sources import lines, tables
from cedarlog.sources.feed import CATALOG_ROWS
from cedarlog.sources.lines import ROTATED_LOGS, read_lines
from cedarlog.sources.render import write_lines

NOW = "2025-12-01 00:00:00"
LINES = [
    "2025-11-20 08:30:00 INFO oven-line: Batch baked tray=14 minutes=22",
    "2025-11-20 08:31:00 ERROR cold-room: Door alarm holder=marta panel=192.0.2.41 state=open",
    "2025-11-21 08:32:00 WARN flour-silo: Level below mark silo=east percent=9",
    "2025-11-21 08:33:00 INFO oven-line: Batch baked tray=15 minutes=24",
    "2025-11-21 08:34:00 ERROR cold-room: Door alarm holder=jonas panel=198.51.100.7 state=ajar",
]


@pytest.fixture
def zone(tmp_path):
    folder = tmp_path / "zone"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.log").write_text("\n".join(LINES[:3]) + "\n\n   \n")
    (folder / "b.log").write_text("\n".join(LINES[3:]))
    (folder / "a.log.1").write_text(LINES[0] + "\n")
    (folder / "a.log.2.gz").write_bytes(gzip.compress((LINES[1] + "\n").encode()))
    (folder / "notes.txt").write_text("no log\n")
    (folder / "sub" / "c.log").write_text(LINES[0] + "\n")
    return str(folder)


def test_only_log_files_of_the_folder_itself(spark, zone):
    rows = read_lines(spark, zone).filter("length(trim(value)) > 0").collect()
    assert sorted(r.value for r in rows) == sorted(LINES)
    assert {r.source_file for r in rows} == {"a.log", "b.log"}


def test_rotated_and_compressed_files(spark, zone):
    files = {r.source_file for r in read_lines(spark, zone, ROTATED_LOGS).collect()}
    assert files == {"a.log", "b.log", "a.log.1", "a.log.2.gz"}


def test_missing_folder_gives_no_rows(spark, tmp_path):
    assert read_lines(spark, str(tmp_path / "none")).count() == 0
    assert not bulk_load(spark, str(tmp_path / "none"), "x", "y", 2025, NOW)


def test_tasks_of_spread_grow_in_number_with_the_stored_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lines, "SPLIT", 20_000)
    for n in (20_000, 80_000):
        spark.range(n).select(F.md5(F.col("id").cast("string")).alias("v")).coalesce(1).write.parquet(f"{tmp_path}/{n}")
    small, big = (lines.spread(spark.read.parquet(f"{tmp_path}/{n}")) for n in (20_000, 80_000))
    assert big.rdd.getNumPartitions() > 3 * small.rdd.getNumPartitions() > 3 * 8
    assert big.count() == 80_000
    # A size that the planner does not know asks for no more tasks than cores.
    assert lines.spread(spark.createDataFrame([("a",)], "v string")).rdd.getNumPartitions() == 8


def test_bulk_load_twice(spark, zone, tmp_path):
    logs, templates = str(tmp_path / "logs"), str(tmp_path / "templates")
    assert tables.read_logs(spark, logs).count() == 0
    assert bulk_load(spark, zone, logs, templates, 2025, NOW)
    rows = tables.read_logs(spark, logs).orderBy("timestamp").collect()
    assert len(rows) == 5
    assert rows[0].body == "Batch baked <*> <*>"
    assert rows[1].body == "Door alarm <*> panel=<IP_REDACTED> <*>"
    assert json.loads(rows[1].context) == {
        "panel": "<IP_REDACTED>", "state": "open", "holder": "marta", "source_file": "a.log",
    }
    assert bulk_load(spark, zone, logs, templates, 2025, NOW)
    assert tables.read_logs(spark, logs).count() == 10
    sizes = {r.template: r.size for r in load_templates(spark, templates).collect()}
    assert len(sizes) == 3 and sum(sizes.values()) == 10


def test_date_predicate_prunes_partitions(spark, zone, tmp_path):
    from cedarlog.operators.queries import LogFilter, count_logs

    logs = str(tmp_path / "logs")
    tables.write_logs(with_signatures(structure(read_lines(spark, zone), 2025, NOW)), logs)
    df = count_logs(tables.read_logs(spark, logs), LogFilter("oven-line", since="2025-11-21 00:00:00"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan and "PushedFilters: [IsNotNull(" in plan
    assert df.first().n == 1


def test_describe_and_raw_sql(spark):
    df = spark.createDataFrame([("a", 1)], "service_name string, n int")
    assert {tuple(r) for r in tables.describe(df).collect()} == {("service_name", "string"), ("n", "int")}
    assert tables.run_sql(spark, "SELECT sum(n) AS s FROM {logs}", logs=df).first().s == 1
    with pytest.raises(ValueError):
        tables.run_sql(spark, "DROP TABLE logs")
    assert "failed" in tables.query_or_error(spark, "SELECT nope FROM {logs}", logs=df).first().error
    assert "Could not" in tables.query_or_error(spark, None).first().error


def test_sql_tool_only_reads_and_always_answers(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "a int, b string").createOrReplaceTempView("seen")
    spark.sql(f"CREATE TABLE kept (a int, b string) USING parquet LOCATION '{tmp_path}/kept'")
    try:
        for text in (
            "WITH c AS (SELECT a, b FROM seen) INSERT INTO kept SELECT a, b FROM c", "INSERT INTO kept VALUES (1, 'x')",
            "WITH c AS (SELECT 1) FROM c INSERT INTO kept SELECT 1, 'x'", "DROP TABLE kept", "SET spark.x = 1", "CACHE TABLE seen",
            "CREATE TABLE other AS SELECT 1", f"INSERT OVERWRITE DIRECTORY '{tmp_path}/out' USING parquet SELECT 1 AS a",
            "select reflect('java.lang.System', 'getenv', 'HOME')", "/* a comment */ TRUNCATE TABLE kept", "EXECUTE IMMEDIATE 'DROP TABLE kept'", "BEGIN DROP TABLE kept; END",
        ):
            with pytest.raises(ValueError):
                tables.run_sql(spark, text)
            assert "only queries" in tables.query_or_error(spark, text).first().error
        assert spark.table("kept").count() == 0 and not (tmp_path / "out").exists()
        for text, want in (
            ("SELECT a, a FROM seen", [(1, 1)]), ("/* first */ (SELECT a FROM seen) UNION ALL VALUES (2)", [(1,), (2,)]),
            ("FROM seen SELECT count(*)", [(1,)]), ("WITH c AS (SELECT a FROM seen) SELECT * FROM c ORDER BY a", [(1,)]),
            ("SELECT 'INSERT INTO kept' AS t", [("INSERT INTO kept",)]),
        ):
            assert sorted(map(tuple, tables.query_or_error(spark, text).collect())) == want
        for text in ("SELECT CAST(b AS INT) FROM seen", "SELECT nope FROM seen", "SELECT", "SELECT 1/0", "}{"):
            assert "failed" in tables.query_or_error(spark, text).first().error
    finally:
        spark.sql("DROP TABLE IF EXISTS kept")


def test_catalog_chat_and_golden_files(spark, tmp_path):
    path = tmp_path / "catalog.csv"
    path.write_text(
        "system_name,department,owner_email,criticality\n" + "\n".join(",".join(r) for r in CATALOG_ROWS)
    )
    assert tables.read_catalog(spark, str(path)).count() == len(CATALOG_ROWS)
    assert spark.table("system_catalog").filter("department = 'Premises'").count() == 1
    chat = str(tmp_path / "chat")
    assert tables.read_chat(spark, chat).count() == 0
    message = spark.createDataFrame([("s", "user", "hi")], "session_id string, role string, content string")
    tables.append_chat(message, chat)
    tables.append_chat(message, chat)
    rows = tables.read_chat(spark, chat).collect()
    assert len({r.id for r in rows}) == 2 and rows[0].content == "hi"
    golden = tmp_path / "g.json"
    golden.write_text('[{"id":"a","query":"q","expected_sql":"s"},\n {"id":"b","query":"q","expected_sql":"t"}]')
    assert tables.read_golden(spark, str(golden), schema.GOLDEN_SQL).count() == 2


def test_purge_rewrites_only_touched_days(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame(
        [("2025-01-01 00:00:00", "a"), ("2025-01-01 00:00:00", "b"), ("2025-01-02 00:00:00", "a"), ("2025-01-03 00:00:00", "b")],
        "timestamp string, host string",
    ).withColumn("timestamp", F.to_timestamp("timestamp"))
    tables.write_logs(df, path)
    purge_table(spark.read.parquet(path), spark.createDataFrame([("a",)], "host string"), "host", path)
    rows = spark.read.parquet(path).collect()
    assert sorted((str(r.log_date), r.host) for r in rows) == [("2025-01-01", "b"), ("2025-01-03", "b")]


def test_stitching_over_file_splits(spark, tmp_path):
    folder = tmp_path / "multi"
    folder.mkdir()
    want, text = [], []
    for i in range(400):
        record = [f"2025-11-20 10:00:{i % 60:02d} ERROR s: failure {i}"] + [f"  at frame {j}" for j in range(i % 5)]
        want.append("\n".join(record))
        text += record
    (folder / "a.log").write_text("orphan\n" + "\n".join(text) + "\n")
    (folder / "b.log").write_text(want[1] + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        lines = read_lines(spark, str(folder), positions=True)
        assert lines.rdd.getNumPartitions() > 5
        got = stitch(lines, is_head(F.col("value"))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    a = sorted((r for r in got if r.source_file == "a.log"), key=lambda r: r.record)
    assert [r.value for r in a] == ["orphan"] + want
    assert [r.value for r in got if r.source_file == "b.log"] == [want[1]]


def test_long_records_are_joined_in_parts(spark):
    rows = [("f", 0, 0, "HEAD")] + [("f", i // 10, i, f"l{i}") for i in range(1, 25)]
    df = spark.createDataFrame(rows, "source_file string, block int, line_id int, value string")
    (got,) = stitch(df, F.col("value") == "HEAD", part_lines=10).collect()
    assert got.n_lines == 25 and got.value.split("\n") == [r[3] for r in rows]


def test_lines_are_written_by_service(spark, tmp_path):
    df = spark.createDataFrame([("auth", "x"), ("pay", "y")], "service_name string, value string")
    write_lines(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out" / "service_name=auth")).first().value == "x"


def test_jobs_remove_their_intermediate_tables(spark, zone, tmp_path):
    from pathlib import Path

    from cedarlog.session import shared_dir

    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.iterdir())
    bulk_load(spark, zone, str(tmp_path / "l"), str(tmp_path / "t"), 2025, NOW)
    assert set(shared.iterdir()) == before
    rows = tables.read_logs(spark, str(tmp_path / "l"))
    assert rows.count() == 5 and "load_id" not in rows.columns
    loads = tables.read_loads(spark, str(tmp_path / "l"))
    purge_table(loads, spark.createDataFrame([("cold-room",)], "service_name string"), "service_name", str(tmp_path / "l"))
    assert tables.read_logs(spark, str(tmp_path / "l")).count() == 3 and set(shared.iterdir()) == before


def test_tiers_move_without_a_second_copy(spark, tmp_path):
    from cedarlog.operators.history import move_tiers, write_tiers

    path = str(tmp_path / "tiers")
    df = spark.createDataFrame([("2024-01-05 01:00:00",), ("2024-03-01 01:00:00",)], "t string").select(
        F.to_timestamp("t").alias("timestamp"), F.to_date("t").alias("log_date")
    )
    write_tiers(df, path, "2024-01-10")
    moved = [move_tiers(spark, path, d) for d in ("2024-01-20", "2024-03-10", "2024-03-10", "2025-02-01")]
    assert moved == [0, 1, 0, 2]
    rows = spark.read.parquet(path).select("tier", F.col("log_date").cast("string")).collect()
    assert sorted(map(tuple, rows)) == [("cold", "2024-01-05"), ("warm", "2024-03-01")]
