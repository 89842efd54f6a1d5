"""The whole load: stitching, rules, quarantine, one parse; late rows; seasonal forecasts."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cedarlog.operators import forecast as fc
from cedarlog.plans.ingest import bulk_load
from cedarlog.sources.tables import read_logs
from cedarlog.streaming import late

NOW = "2025-12-01 00:00:00"


def test_load_with_traces_rules_and_quarantine(spark, tmp_path):
    zone = tmp_path / "zone"
    zone.mkdir()
    (zone / "mill.log").write_text(
        "2025-11-20 08:30:00 ERROR mill: Stone stopped\n  at gear 1\n  at gear 2\n"
        "<2025-11-20T08:31:00> warn / wheel 7 is loose\n"
        '{"level":"WARN","service":"mill","message":"m","v":NaN,"a":1,"a":2}\n'
    )
    (zone / "bus.log").write_text("no record at all\n2025-11-20 08:32:00 INFO bus: Late by 4\n")
    rules = spark.createDataFrame(
        [("mill", 1, r"<(?P<timestamp>[^>]+)> (?P<level>\w+) / (?P<message>.*)"), ("bus", 1, r"(?P<x>never)")],
        "service_name string, attempt int, pattern string",
    )
    where = (str(zone), f"{tmp_path}/logs", f"{tmp_path}/templates", 2025, NOW)
    assert bulk_load(spark, *where, rules=rules, quarantine_path=f"{tmp_path}/bad")
    rows = {r.message: r for r in read_logs(spark, f"{tmp_path}/logs").collect()}
    assert set(rows) == {"Stone stopped", "wheel 7 is loose", "m", "Late by 4"}
    ruled = rows["wheel 7 is loose"]
    assert (ruled.service_name, ruled.severity, str(ruled.timestamp)) == ("mill", "warn", "2025-11-20 08:31:00")
    bad = spark.read.parquet(f"{tmp_path}/bad")
    assert sorted(r.message for r in bad.collect()) == ["at gear 1", "at gear 2", "no record at all"]

    out = f"{tmp_path}/second"
    assert bulk_load(spark, str(zone), f"{out}/logs", f"{out}/templates", 2025, NOW, multiline=True, quarantine_path=f"{out}/bad")
    messages = {r.message for r in read_logs(spark, f"{out}/logs").collect()}
    assert any(m.split() == "Stone stopped at gear 1 at gear 2 <2025-11-20T08:31:00> warn / wheel 7 is loose".split() for m in messages)
    assert [r.message for r in spark.read.parquet(f"{out}/bad").collect()] == ["no record at all"]


# ---------------------------------------------------------------- late rows


@pytest.mark.parametrize("files", [1, 4])
def test_counted_and_late_rows_add_up(spark, tmp_path, files):
    rng = random.Random(6)
    start = dt.datetime(2025, 3, 2)
    rows = [(start + dt.timedelta(minutes=rng.randint(0, 3000)), "ERROR" if rng.random() < 0.2 else "INFO", f"s{rng.randint(0, 2)}") for _ in range(400)]
    rows += [(None, "INFO", "s0"), (None, "ERROR", None)]
    rng.shuffle(rows)
    shape = "timestamp timestamp, severity string, source_file string"
    for i in range(5):
        spark.createDataFrame(rows[i::5], shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(shape).option("maxFilesPerTrigger", files).parquet(f"{tmp_path}/in")
    late.start_counting(source, f"{tmp_path}/out", f"{tmp_path}/state", "2 hours").awaitTermination()
    counted = late.period_counts(spark, f"{tmp_path}/out", "2 hours").collect()
    behind = late.late_rows(spark, f"{tmp_path}/out").collect()
    assert sum(r.n for r in counted) + sum(r.n for r in behind) == len(rows)
    assert sum(r.n for r in behind if r.hour is None) == 2
    # By hand: the micro-batches as the stream read them, each against the largest time of those before.
    batches = [r["batch"] for r in spark.read.parquet(f"{tmp_path}/out/seen").orderBy("batch").collect()]
    assert len(batches) == -(-5 // files)
    end = late.watermark(spark, f"{tmp_path}/out", "2 hours")
    assert end == max(r[0] for r in rows if r[0]) - dt.timedelta(hours=2)
    assert all(r.closed == (r.period + dt.timedelta(hours=1) <= end) for r in counted)
    if files == 1:
        assert len(behind) > 2
    # A repeated micro-batch changes nothing, nor does bringing folders together.
    before = [sorted(map(str, counted)), sorted(map(str, behind))]
    late.compact_counts(spark, f"{tmp_path}/out")
    after = [sorted(map(str, late.period_counts(spark, f"{tmp_path}/out", "2 hours").collect())), sorted(map(str, late.late_rows(spark, f"{tmp_path}/out").collect()))]
    assert before == after


def test_late_rows_batch_by_batch(spark, tmp_path):
    shape = "timestamp timestamp, severity string, source_file string"
    at = lambda h, m=0: dt.datetime(2025, 3, 2, h, m)
    write = late.count_batch(str(tmp_path), "1 hour")
    put = lambda i, *rows: write(spark.createDataFrame(list(rows), shape), i)
    put(0, (at(10, 30), "INFO", "a"), (at(12), "ERROR", "a"))  # the watermark is 11:00 from now on
    put(1, (at(10, 59), "INFO", "b"), (at(11, 0), "INFO", "b"), (at(9), "ERROR", "c"))
    put(1, (at(10, 59), "INFO", "b"), (at(11, 0), "INFO", "b"), (at(9), "ERROR", "c"))
    put(2)
    put(3, (at(11, 5), "INFO", "b"))
    got = {(r.source, r.hour): r.n for r in late.late_rows(spark, str(tmp_path)).collect()}
    assert got == {("b", at(10)): 1, ("c", at(9)): 1}
    assert {r.period: (r.n, r.errors, r.closed) for r in late.period_counts(spark, str(tmp_path)).collect()} == {
        at(10): (1, 0, True), at(11): (2, 0, False), at(12): (1, 1, False)}


# ---------------------------------------------------------------- forecasts


def _plain_fit(y, season):
    """Holt-Winters over the grid in plain Python."""
    best = None
    for a in fc.GRID:
        for b in fc.GRID:
            for g in fc.GRID:
                first = sum(y[:season]) / season
                level, trend = first, (sum(y[season : 2 * season]) / season - first) / season
                seasons, wrong = [v - first for v in y[:season]], 0.0
                for t, v in enumerate(y):
                    s = seasons[t % season]
                    if t >= 2 * season:
                        wrong += (v - level - trend - s) ** 2
                    old, level = level, a * (v - s) + (1 - a) * (level + trend)
                    trend = b * (level - old) + (1 - b) * trend
                    seasons[t % season] = g * (v - level) + (1 - g) * s
                if best is None or wrong < best[0] * (1 - 1e-12) - 1e-12:
                    best = (wrong, (a, b, g), level, trend, seasons)
    return best[1], [best[2] + k * best[3] + best[4][(len(y) + k - 1) % season] for k in range(1, season + 1)]


def _seasonal_logs(spark, days=12):
    rng = random.Random(3)
    rows = []
    for service, scale in (("day", 6), ("night", 4)):
        for hour in range(24 * days):
            wave = 1 + np.sin((hour % 24 + (0 if service == "day" else 12)) / 24 * 2 * np.pi)
            rows += [(service, dt.datetime(2025, 3, 1) + dt.timedelta(hours=hour, minutes=m)) for m in range(int(scale * wave + rng.random() * 2))]
    rows += [("rare", dt.datetime(2025, 3, 5, 7)), ("rare", None), (None, dt.datetime(2025, 3, 5, 7))]
    return spark.createDataFrame(rows, "service_name string, timestamp timestamp")


def test_forecast_equals_plain_python_and_beats_a_line(spark):
    logs = _seasonal_logs(spark)
    counted = {}
    for r in fc.series(logs, "service_name").collect():
        counted.setdefault(r.service_name, {})[r["at"]] = r.n
    assert len({frozenset(v) for v in counted.values()}) == 1 and len(counted) == 4
    got = {}
    for r in fc.forecast(logs).collect():
        got.setdefault(r.service_name, []).append(r)
    for service, values in counted.items():
        rows = sorted(got[service], key=lambda r: r.lead)
        y = [float(values[k]) for k in sorted(values)]
        params, ahead = _plain_fit(y, 24)
        assert [r.forecast for r in rows] == pytest.approx(ahead, abs=1e-6)
        assert (rows[0].alpha, rows[0].beta, rows[0].gamma) == params
        assert all(r.low <= r.high for r in rows)
        assert rows[0].period == dt.datetime(1970, 1, 1) + dt.timedelta(hours=max(values) + 1)
    tested = {r.service_name: r for r in fc.back_test(logs).collect()}
    for service in ("day", "night"):
        assert tested[service].season_error < 0.6 * tested[service].trend_error
        assert tested[service].covered > 0.6


def test_short_series_and_none(spark):
    logs = spark.createDataFrame([("a", dt.datetime(2025, 3, 1, 5)), ("a", dt.datetime(2025, 3, 1, 7))], "service_name string, timestamp timestamp")
    rows = fc.forecast(logs, ahead=2).collect()
    assert [round(r.forecast, 6) for r in rows] == [round(2 / 3, 6)] * 2 and rows[0].alpha != rows[0].alpha or rows[0].alpha is None
    assert fc.forecast(logs.limit(0)).count() == 0
