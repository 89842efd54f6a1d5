"""Files that grow and rotate between loads."""

import gzip

from pyspark.sql import functions as F

from cedarlog.plans.ingest import bulk_load
from cedarlog.sources.rotation import load_ledger, read_new_lines, save_ledger
from cedarlog.sources.tables import read_logs


def _load(spark, folder, ledger):
    before, version = load_ledger(spark, ledger)
    new, after = read_new_lines(spark, str(folder), before)
    rows = sorted(r.value for r in new.collect())
    save_ledger(after, ledger, version + 1)
    return rows


def test_each_line_is_read_once(spark, tmp_path):
    zone, ledger = tmp_path / "zone", f"{tmp_path}/ledger"
    assert _load(spark, zone, ledger) == []
    zone.mkdir()
    (zone / "x.log").write_text("banner\nx1\nx2\n")
    (zone / "y.log").write_text("banner\ny1\nunfinish")
    (zone / "empty.log").write_text("")
    (zone / "notes.txt").write_text("no log\n")
    assert _load(spark, zone, ledger) == ["banner", "banner", "x1", "x2", "y1"]
    assert _load(spark, zone, ledger) == []
    with (zone / "y.log").open("a") as f:
        f.write("ed\ny3\n")
    (zone / "x.log").rename(zone / "x.log.1")
    with (zone / "x.log.1").open("a") as f:
        f.write("x3\n")  # written just before the rotation
    (zone / "x.log").write_text("banner\nz1\n")  # a new file with the same first line
    assert _load(spark, zone, ledger) == ["banner", "unfinished", "x3", "y3", "z1"]
    with gzip.open(zone / "x.log.2.gz", "wt") as f:
        f.write((zone / "x.log.1").read_text())
    (zone / "x.log").rename(zone / "x.log.1")
    (zone / "x.log").write_text("banner\nw1\nw2\n")
    assert _load(spark, zone, ledger) == ["banner", "w1", "w2"]
    assert _load(spark, zone, ledger) == []
    stored, version = load_ledger(spark, ledger)
    assert version == 4 and sorted(r.consumed for r in stored.collect()) == [2, 3, 4, 4]


def test_copies_in_one_load(spark, tmp_path):
    zone, ledger = tmp_path / "zone", f"{tmp_path}/ledger"
    zone.mkdir()
    (zone / "a.log").write_text("one\ntwo\nthree\n")
    (zone / "a.log.1").write_text("one\ntwo\n")  # copied while the original went on
    (zone / "b.log").write_text("one\nother\n")
    (zone / "c.log.1").write_text("same\nsame\n")
    with gzip.open(zone / "c.log.2.gz", "wt") as f:
        f.write("same\nsame\n")
    assert _load(spark, zone, ledger) == ["one", "one", "other", "same", "same", "three", "two"]
    assert _load(spark, zone, ledger) == []


def test_bulk_load_between_rotations(spark, tmp_path):
    zone = tmp_path / "zone"
    zone.mkdir()
    line = "2025-03-02 06:15:{:02d} INFO tide-gauge: Water at pier={} metres"
    (zone / "g.log").write_text("".join(line.format(i, i) + "\n" for i in range(5)))
    where = {"logs_path": f"{tmp_path}/logs", "templates_path": f"{tmp_path}/templates", "default_year": 2025,
             "ingest_ts": "2025-12-01 00:00:00", "ledger_path": f"{tmp_path}/ledger"}
    assert bulk_load(spark, str(zone), **where)
    (zone / "g.log").rename(zone / "g.log.1")
    (zone / "g.log").write_text("".join(line.format(i, i) + "\n" for i in range(10, 13)))
    assert bulk_load(spark, str(zone), **where)
    assert not bulk_load(spark, str(zone), **where)
    assert read_logs(spark, f"{tmp_path}/logs").count() == 8


def test_files_of_the_feed_are_bounded_and_grow_at_their_end(spark, tmp_path, monkeypatch):
    from cedarlog.registry import jobs

    monkeypatch.setattr(jobs, "FILE", 10)
    lines = spark.range(35).repartition(3).select(F.col("id").alias("event_id"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("value"))
    held = {}
    for name, part in (("before", lines.filter("event_id <= 17")), ("after", lines)):
        jobs._write_files(part, 34, f"{tmp_path}/{name}")
        texts = sorted((p.read_text().split("\n")[:-1] for p in (tmp_path / name).glob("*.txt")), key=lambda t: int(t[0].split()[1]) if t else -1)
        held[name] = [t for t in texts if t]
    want = [f"line {i}" for i in range(35)]
    assert held["after"] == [want[:10], want[10:20], want[20:30], want[30:]]
    assert held["before"] == [want[:10], want[10:18]]
