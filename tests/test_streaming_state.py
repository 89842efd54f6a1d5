"""Keyed state: templates of a stream and records that go on from file to file."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from cedarlog.operators.stitch import is_head, stitch
from cedarlog.operators.templates import mine_templates
from cedarlog.sources.lines import read_lines
from cedarlog.streaming import stitch as ss
from cedarlog.streaming import templates as st
from cedarlog.streaming.ingest import start_ingest


def _messages(seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice(["tide", "pier", "lock", "crane"])
    out = [None, "", "   ", "<*> literal 4", "5 literal 4", "only once 17 seen"]
    for _ in range(300):
        out.append(rng.choice([
            f"Job {word()} done in {rng.randint(1, 99)} ms", f"Login of u{rng.randint(1, 5)} from gate7 {word()}",
            f"Gate {rng.randint(1, 3)} of lock9 closed", f"{word()} {word()} idle",
        ]))
    return out


def _sorted(df):
    return sorted(map(tuple, df.select("template", "size").collect()))


@pytest.fixture(scope="module")
def message_files(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("messages"))
    df = spark.createDataFrame([(m,) for m in _messages()], "message string").filter("trim(message) <> ''")
    df.repartition(5).write.mode("append").parquet(folder)
    return folder, df


def _track(spark, folder, out, files, **options):
    source = spark.readStream.schema("message string").option("maxFilesPerTrigger", files).parquet(folder)
    job = st.track_templates(source, f"{out}/signatures", f"{out}/state", **options)
    assert job.awaitTermination(240)


@pytest.mark.parametrize("files", [2, 50])
def test_stream_templates_equal_batch_for_any_batching(spark, message_files, tmp_path, files):
    folder, df = message_files
    _track(spark, folder, tmp_path, files)
    assert _sorted(st.tracked_templates(spark, f"{tmp_path}/signatures")) == _sorted(mine_templates(df))


def test_stream_templates_after_restart_replay_and_compaction(spark, message_files, tmp_path):
    folder, df = message_files
    grown = tmp_path / "grown"
    df.limit(120).coalesce(1).write.mode("append").parquet(str(grown))
    _track(spark, str(grown), tmp_path, 1)
    more = spark.createDataFrame([("Gate 4 of lock8 closed",), ("Brand new line",)], "message string")
    more.coalesce(1).write.mode("append").parquet(str(grown))
    _track(spark, str(grown), tmp_path, 1)  # goes on from the checkpoint
    more.coalesce(1).write.mode("append").parquet(str(grown))
    _track(spark, str(grown), tmp_path, 1)
    want = _sorted(mine_templates(spark.read.parquet(str(grown))))
    path = f"{tmp_path}/signatures"
    assert _sorted(st.tracked_templates(spark, path)) == want
    # The last micro-batch once more, as after a lost executor, changes nothing.
    newest = spark.read.parquet(path).agg(F.max("batch")).first()[0]
    kept = spark.read.parquet(f"{path}/batch={newest}").collect()
    spark.createDataFrame(kept, "sig string, n bigint, pos array<int>, lows array<string>, highs array<string>, gone boolean").write.mode("overwrite").parquet(f"{path}/batch={newest}")
    st.compact_signatures(spark, path)
    assert spark.read.parquet(path).select("batch").distinct().count() == 2
    assert _sorted(st.tracked_templates(spark, path)) == want
    st.compact_signatures(spark, path)
    assert _sorted(st.tracked_templates(spark, path)) == want


def test_unused_signature_is_retired(spark, tmp_path):
    def put(*texts):
        spark.createDataFrame([(t,) for t in texts], "message string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    put("Old line 1", "Kept line 1")
    _track(spark, f"{tmp_path}/in", tmp_path, 1, retire_after="2 seconds")
    time.sleep(4)
    put("Kept line 2")
    _track(spark, f"{tmp_path}/in", tmp_path, 1, retire_after="2 seconds")
    path = f"{tmp_path}/signatures"
    assert _sorted(st.tracked_templates(spark, path)) in ([("Kept line <*>", 2)], [("Kept line 2", 1)])
    put("Old line 1")
    _track(spark, f"{tmp_path}/in", tmp_path, 1, retire_after="1 hour")
    assert ("Old line 1", 1) in _sorted(st.tracked_templates(spark, path))


def test_no_stream_no_templates(spark, tmp_path):
    assert st.tracked_templates(spark, f"{tmp_path}/nothing").count() == 0


# ---------------------------------------------------------------- records over files

HEAD = "2025-03-02 06:15:00 ERROR crane: "


def _write(folder, files):
    """Files in the order they are to be read."""
    for i, (name, lines) in enumerate(files):
        path = folder / name
        path.write_text("".join(x + "\n" for x in lines))
        os.utime(path, (1_700_000_000 + 10 * i,) * 2)


def _zone(seed=2):
    """Logs in several files each; stack traces go on in the next file, some files hold no head at all."""
    rng = random.Random(seed)
    files = []
    for part in range(7):
        for log in ("crane", "gate", "pier"):
            lines = []
            for i in range(rng.randint(0, 4)):
                lines.append(f"{HEAD}{log} failed {part}-{i}")
                lines += [f"    at {log}.part{part}.step{k}" for k in range(rng.choice([0, 0, 2, 5]))]
            lead = [f"    lead {log} {part} {k}" for k in range(rng.choice([0, 0, 1, 3]))]
            if lead + lines:
                files.append((f"{log}-{part:02d}.log", lead + lines))
    return files


def _expected(files):
    """Records by log, joined over its files in order."""
    logs = {}
    for name, lines in files:
        logs.setdefault(name.split("-")[0], []).extend(lines)
    out = []
    for log, lines in logs.items():
        record = []
        for x in lines:
            if x.startswith(HEAD) and record:
                out.append((f"{log}.log", "\n".join(record), len(record)))
                record = []
            record.append(x)
        out.append((f"{log}.log", "\n".join(record), len(record)))
    return sorted(out)


def _run(spark, folder, out, files, idle="1 hour"):
    def write(batch, i):
        batch.write.mode("overwrite").parquet(f"{out}/records/batch={i}")

    lines = ss.stream_parts(spark, str(folder), files_per_batch=files)
    job = (
        ss.stitch_stream(lines, idle=idle).writeStream.option("checkpointLocation", f"{out}/state")
        .foreachBatch(write).trigger(availableNow=True).start()
    )
    assert job.awaitTermination(240)


def _records(spark, out):
    closed = spark.read.parquet(f"{out}/records").select("log", "value", "n_lines")
    still = ss.open_records(spark, f"{out}/state").select("log", "value", "n_lines")
    return sorted(map(tuple, closed.unionByName(still).collect()))


@pytest.mark.parametrize("files", [3, 50])
def test_stream_stitching_equals_batch_for_any_batching(spark, tmp_path, files):
    folder = tmp_path / "zone"
    folder.mkdir()
    zone = _zone()
    _write(folder, zone)
    _run(spark, folder, tmp_path, files)
    assert _records(spark, tmp_path) == _expected(zone)
    # The batch form over one file for each log finds the same records.
    whole = tmp_path / "whole"
    whole.mkdir()
    for log in ("crane", "gate", "pier"):
        (whole / f"{log}.log").write_text("".join(x + "\n" for name, lines in zone if name.startswith(log) for x in lines))
    lines = read_lines(spark, str(whole), positions=True)
    batch = stitch(lines, is_head(F.col("value"))).select("source_file", "value", F.col("n_lines").cast("bigint"))
    assert sorted(map(tuple, batch.collect())) == _expected(zone)


def test_record_goes_on_after_a_restart_and_closes_by_time(spark, tmp_path):
    folder = tmp_path / "zone"
    folder.mkdir()
    _write(folder, [("crane-1.log", [HEAD + "a", "  at x"]), ("gate-1.log", [HEAD + "g"])])
    _run(spark, folder, tmp_path, 10, idle="2 seconds")
    assert not spark.read.parquet(f"{tmp_path}/records").count()
    time.sleep(4)
    path = folder / "crane-2.log"
    path.write_text("  at y\n")
    _run(spark, folder, tmp_path, 10, idle="2 seconds")
    closed = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/records").select("log", "value").collect()))
    assert ("gate.log", HEAD + "g") in closed
    assert ("crane.log", f"{HEAD}a\n  at x\n  at y", 3) in _records(spark, tmp_path)


def test_fragments_do_not_depend_on_arrow_batches(spark, tmp_path):
    folder = tmp_path / "zone"
    folder.mkdir()
    zone = _zone(5)
    _write(folder, zone)
    lines = spark.read.text(str(folder)).select(
        "value", F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_block_start").alias("block"),
    )
    columns = ["log", "source_file", "nth", "kind", "closes", "value", "n_lines"]
    found = []
    for size in ("10000", "1", "3"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        found.append(sorted(map(tuple, ss.fragments(lines).select(*columns).collect()), key=str))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = [[f for f in x if f[3] == ss.WHOLE] for x in found]
    assert found[0] == found[1] == found[2] and whole[0]


def test_stream_load_stitches_applies_rules_and_knows_its_year(spark, tmp_path):
    folder = tmp_path / "zone"
    folder.mkdir()
    _write(folder, [
        ("crane-1.log", [HEAD + "Hook 7 lost", "  at step1"]), ("crane-2.log", ["  at step2", HEAD + "Hook 8 found", HEAD + "end"]),
        ("mill-1.log", ["{\"message\":\"x\"}", "{\"message\":\"y\"}"]),
        ("web-1.log", ["Jan  1 00:00:01 h sshd: hello", "Dec 31 23:59:59 h sshd: bye", "Jan  1 00:00:02 h sshd: last"]),
    ])
    rules = spark.createDataFrame([("mill", 1, r'\{"message":"(?P<message>x)"\}')], "service_name string, attempt int, pattern string")
    job = start_ingest(ss.stream_parts(spark, str(folder), files_per_batch=1), f"{tmp_path}/logs", f"{tmp_path}/state", multiline=True, rules=rules)
    assert job.awaitTermination(240)
    rows = spark.read.parquet(f"{tmp_path}/logs").collect()
    by = {r.message: r for r in rows}
    assert any(m.split() == "Hook 7 lost at step1 at step2".split() for m in by) and "Hook 8 found" in by
    assert by["x"].service_name == "mill"
    import datetime as dt

    now = dt.datetime.now(dt.timezone.utc)
    assert by["hello"].timestamp.year == now.year and by["bye"].timestamp.year == now.year - (now.month < 12)
