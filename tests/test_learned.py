"""Profiles and change points, episodes, forgetting by filter, induced patterns."""

import datetime as dt
import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cedarlog.operators import baseline as bl
from cedarlog.operators import episodes as ep
from cedarlog.operators import forget as fg
from cedarlog.operators import induce
from cedarlog.operators.rules import apply_rules, select_rules, validate_rules

START = dt.datetime(2025, 3, 3)  # a Monday


def _hourly(spark, weeks=5, shift=None):
    """Counts by hour with a daily wave; from hour ``shift`` on the service ``a`` has more rows."""
    rng = random.Random(8)
    rows = []
    for h in range(weeks * 168):
        base = 6 + round(4 * np.sin(h % 24 / 24 * 2 * np.pi))
        for service in ("a", "b"):
            n = base + rng.randint(-1, 1) + (14 if service == "a" and shift is not None and h >= shift else 0)
            rows += [(service, START + dt.timedelta(hours=h, minutes=m)) for m in range(n)]
    return spark.createDataFrame(rows, "service_name string, timestamp timestamp")


def test_scores_against_quantiles_and_merged_profiles(spark, tmp_path):
    logs = _hourly(spark)
    counted = bl.hours(logs).persist()
    assert counted.filter("hour_of_week = 0").agg(F.min("at")).first()[0] * 3600 == START.replace(tzinfo=dt.timezone.utc).timestamp()
    whole = bl.profile(counted)
    for i in range(3):
        bl.save_profile(bl.profile(counted.filter(F.col("at") % 3 == i)), str(tmp_path / "p"), f"load-{i}")
    bl.save_profile(bl.profile(counted.filter("at % 3 = 2")), str(tmp_path / "p"), "load-2")
    key = lambda df: sorted((r.service_name, r["at"], r.median, round(r.spread, 9), round(r.score, 9)) for r in df.collect())
    got = key(bl.robust_scores(counted, whole))
    assert got == key(bl.robust_scores(counted, bl.read_profile(spark, str(tmp_path / "p"))))
    by_hand = {}
    for r in counted.collect():
        by_hand.setdefault((r.service_name, r.hour_of_week), []).append(r.n)
    for service, at, median, spread, _ in got[:400]:
        n = sorted(by_hand[service, (at + 72) % 168])
        at_rank = lambda q: n[max(int(np.ceil(q * len(n))) - 1, 0)]  # noqa: B023,E731
        assert median == at_rank(0.5)
        assert spread == pytest.approx(max((at_rank(0.75) - at_rank(0.25)) / 1.349, median**0.5, 1.0))


def test_sketch_of_many_values_is_near_and_mergeable(spark):
    many = spark.range(50_000).select(F.lit("a").alias("service_name"), F.lit(0).alias("hour_of_week"), F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("n"), (F.col("id") % 7).alias("part"))
    one = bl.profile(many)
    parts = None
    for i in range(7):
        p = bl.profile(many.filter(f"part = {i}"))
        parts = p if parts is None else parts.unionByName(p)
    merged = parts.groupBy("service_name", "hour_of_week").agg(F.kll_merge_agg_bigint("sketch").alias("sketch"))
    for df in (one, merged):
        (r,) = df.select(*[F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)]).collect()
        assert all(abs(v / 100_000 - q) < 0.03 for v, q in zip(r, (0.25, 0.5, 0.75), strict=True))


def test_planted_shift_is_found_to_the_hour(spark):
    shift = 4 * 168 + 30
    counted = bl.hours(_hourly(spark, shift=shift))
    known = bl.profile(counted.filter(F.col("at") * 3600 < (START + dt.timedelta(weeks=4)).replace(tzinfo=dt.timezone.utc).timestamp()))
    found = bl.change_points(bl.robust_scores(counted, known)).orderBy("began").collect()
    first = [r for r in found if r.service_name == "a"][0]
    assert first.began == START + dt.timedelta(hours=shift) and first.direction == 1
    assert not [r for r in found if r.service_name == "b"]


def test_cusum_by_hand():
    assert bl.cusum([0, 0, 3, 3, 3, 0, 0]) == [(2, 4, 1)]
    assert bl.cusum([0, -4, float("nan"), -4]) == [(1, 3, -1)]
    assert bl.cusum([0.4] * 100) == [] and bl.cusum([]) == []
    assert bl.cusum([3, -9, 3, 4, 4]) == [(1, 1, -1), (2, 4, 1)]


# ---------------------------------------------------------------- episodes


def _episodes_by_hand(traces, least, longest):
    support = {}
    for seq in traces.values():
        seen = {s for k in range(1, longest + 1) for s in itertools.combinations(seq, k)}
        for s in seen:
            support[s] = support.get(s, 0) + 1
    return {s: n for s, n in support.items() if n >= least}


@pytest.mark.parametrize("least", [1, 7, 12])
def test_episodes_equal_brute_force(spark, least):
    rng = random.Random(least)
    rows, traces = [], {}
    for t in range(25):
        at = 0
        for _ in range(rng.randint(0, 7)):
            at += rng.randint(0, 2)
            service = rng.choice("abcd")
            for _ in range(rng.choice([1, 1, 5])):
                rows.append((f"t{t}", service, START + dt.timedelta(seconds=at), "ERROR"))
        rows.append((f"t{t}", "e", START, "INFO"))
    rows += [(None, "a", START, "ERROR"), ("t1", None, START, "ERROR"), ("t1", "a", None, "ERROR")]
    for t, s, at, severity in rows:
        if severity == "ERROR" and None not in (t, s, at):
            traces.setdefault(t, []).append((at, s))
    traces = {t: [s for _, s in sorted(v)] for t, v in traces.items()}
    logs = spark.createDataFrame(rows, "trace_id string, service_name string, timestamp timestamp, severity string")
    got = {tuple(r.episode): r.support for r in ep.frequent_episodes(logs, least, 3).collect()}
    assert got == _episodes_by_hand(traces, least, 3)
    assert ep.frequent_episodes(logs.limit(0), 1).count() == 0


# ---------------------------------------------------------------- forgetting


def _times(store):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(store) for f in fs if f.endswith(".parquet")}


def test_subject_is_gone_everywhere_and_other_folders_untouched(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        who = "marta" if i % 300 == 7 else f"user{rng.randint(0, 999)}"
        day = dt.date(2025, 3, 1 + i % 300 // 20)
        rows.append((day, "one" if i < 300 else "two", f"Login of holder={who} ok {i}", '{"account":"%s","k":[1]}' % who, [who, "x"], {"who": who}, float(i)))
    rows.append((dt.date(2025, 3, 20), "one", "Only MARTA's day", None, None, None, None))
    rows.append((dt.date(2025, 3, 21), "one", "martam is another, and so is xmarta", None, ["smarta"], {}, 1.0))
    store, filters, folder = str(tmp_path / "logs"), str(tmp_path / "filters"), ["load_id", "log_date"]
    df = spark.createDataFrame(rows, "log_date date, load_id string, message string, context string, params array<string>, metadata map<string,string>, v double")
    df.write.partitionBy(*folder).parquet(store)
    assert fg.update_filters(spark, store, filters, folder) == 32 and fg.update_filters(spark, store, filters, folder) == 0
    asked = spark.createDataFrame([("Marta",), ("nobody-here",), ("",)], "token string")
    opened = {tuple(map(str, r)) for r in fg.candidates(spark, store, filters, asked, folder).collect()}
    hold = {("one", "2025-03-01"), ("two", "2025-03-01"), ("one", "2025-03-20")}
    assert hold <= opened and len(opened) <= 5
    before = _times(store)
    assert fg.forget(spark, store, filters, asked, folder) == 3
    after = _times(store)
    assert {p for p in before if after.get(p) != before[p]} == {p for p in before if any(f"load_id={a}/log_date={b}" in p for a, b in hold)}
    left = spark.read.parquet(store)
    assert left.count() == len(rows) - 3
    text = " ".join(str(r) for r in left.filter("log_date <> '2025-03-21'").collect()).lower()
    assert "marta" not in text
    assert not os.path.exists(f"{store}/load_id=one/log_date=2025-03-20")
    assert fg.forget(spark, store, filters, asked, folder) == 0 and _times(store) == after
    # A folder without a filter is opened, an unknown subject opens none that has one.
    spark.createDataFrame([rows[7]], df.schema).withColumn("load_id", F.lit("three")).write.mode("append").partitionBy(*folder).parquet(store)
    assert fg.forget(spark, store, filters, asked, folder) == 1
    assert fg.candidates(spark, store, filters, spark.createDataFrame([("zzz-unknown",)], "token string"), folder).count() <= 1


# ---------------------------------------------------------------- induced patterns


def test_induced_patterns_match_all_lines_and_read_their_fields(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        rows.append(("gate", f"Badge accepted holder=h{i} reader=10.0.0.{i % 200} took={i}ms" if i % 3 else f"Badge refused holder=h{i} reader=10.0.0.{i % 200} cause=expired took={i}ms"))
        rows.append(("mill", f"Stone {i} turned {rng.random():.3f} times at 12:0{i % 10}:33"))
        rows.append(("shop", f"GET /item/{i} {200 if i % 2 else 500}"))
        rows.append(("odd", rng.choice(["  started (fast) [ok]", "stopped", "a.b*c? + {x} again and again", "started (fast) [ok] 7"])))
        rows.append(("same", "always the same words"))
    rows += [("mill", None), ("mill", "   "), ("none", None)]
    lines = spark.createDataFrame(rows, "service_name string, line string").repartition(4)
    rules = induce.induce_rules(lines).persist()
    full = lines.filter("trim(line) <> ''")
    assert {r.service_name for r in rules.collect()} == {"gate", "mill", "shop", "odd", "same"}
    assert all(r.ok for r in validate_rules(full, rules.filter("attempt = 1")).collect())
    chosen = {r.service_name: r.attempt for r in select_rules(full, rules).collect()}
    assert chosen == dict.fromkeys(("gate", "mill", "shop", "odd", "same"), 1)
    fields = {r.line: r.fields for r in apply_rules(full, rules.filter("attempt = 1")).collect()}
    gate = next(v for k, v in fields.items() if k.startswith("Badge refused holder=h33 "))
    assert gate["holder"] == "h33" and gate["reader"] == "10.0.0.33" and gate["took"] == "33ms"
    assert fields["GET /item/4 500"] == {"path": "/item/4", "number": "500"}
    mill = next(v for k, v in fields.items() if k.startswith("Stone 8 turned"))
    assert mill["number"] == "8" and set(mill) == {"number", "decimal", "time"}


def test_alignment():
    a, b = [("is", "x"), ("slot", None, "number"), ("is", "z")], [("is", "x"), ("is", "y"), ("slot", None, "decimal"), ("is", "z"), ("is", "w")]
    assert induce.align(a, b) == [("is", "x"), ("gap",), ("slot", None, "decimal"), ("is", "z"), ("gap",)]
    assert induce.align([("is", "p")], [("is", "q")]) == [("gap",)]
    assert induce.to_pattern([("is", "a+"), ("slot", "k.v", "number"), ("slot", None, "number"), ("slot", None, "number")]) == (
        r"\s*a\+\s+k\.v=(?P<k_v>\d+)\s+(?P<number>\d+)\s+(?P<number_2>\d+)\s*$"
    )


def test_documents_are_split_once_for_training_and_placing(spark, monkeypatch):
    from cedarlog.registry import history

    stored, store = [], history.materialise
    monkeypatch.setattr(history, "materialise", lambda df, name: stored.append(name) or store(df, name))
    found = history.categorise_kmeans(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert stored == ["vectors"] and "regexp_replace" not in plan
    assert found.agg({"n": "sum"}).first()[0] == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
