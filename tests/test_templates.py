import pathlib
import random

from pyspark.sql import functions as F

from cedarlog.operators.templates import (
    assign_signatures,
    assign_templates,
    cluster_count,
    current_ids,
    mine_templates,
    new_patterns,
    signature,
    templates_of,
    with_signature_template,
)
from cedarlog.operators import templates
from cedarlog.operators.joins import join_by_weight
from cedarlog.plans.ingest import load_templates, save_next
from cedarlog.session import REMOVE_SHUFFLES, shared_dir

FOUR = [
    "Batch baked at tray=14 minutes=22",
    "Batch baked at tray=15 minutes=24",
    "Door alarm holder=marta by panel=192.0.2.41",
    "Door alarm holder=jonas by panel=198.51.100.7",
]


def messages(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "message string")


def mined(df):
    return {(r.template, r.size) for r in df.select("template", "size").collect()}


def test_four_messages_two_templates(spark):
    got = mine_templates(messages(spark, FOUR))
    assert mined(got) == {("Batch baked at <*> <*>", 2), ("Door alarm <*> by <*>", 2)}
    assert cluster_count(got) == 2


def test_signature_form_gives_three(spark):
    df = with_signature_template(messages(spark, FOUR))
    assert df.select("template").distinct().count() == 3
    assert df.filter("message like '%tray=14%'").first().params == ["tray=14", "minutes=22"]


def test_constant_digits_stay_in_the_template(spark):
    got = mine_templates(messages(spark, ["GET /a HTTP/1.1 5", "GET /a HTTP/1.1 6"]))
    assert mined(got) == {("GET /a HTTP/1.1 <*>", 2)}


def test_threshold(spark):
    texts = ["x a b c", "x a d e"]
    assert mine_templates(messages(spark, texts), similarity=0.5).count() == 1
    assert mine_templates(messages(spark, texts), similarity=0.6).count() == 2


def test_saved_templates_seed_the_next_run(spark, tmp_path):
    path = str(tmp_path / "t")
    assert load_templates(spark, path) is None
    save_next(mine_templates(messages(spark, FOUR)), path)
    save_next(mine_templates(messages(spark, FOUR), seeds=load_templates(spark, path)), path)
    assert mined(load_templates(spark, path)) == {
        ("Batch baked at <*> <*>", 4), ("Door alarm <*> by <*>", 4),
    }


def corpus():
    verbs = ["opened", "closed", "moved", "lost"]
    return [
        f"worker {v} file f{i} in zone {z} after {'x' * (i % 3 + 1)} tries"
        for i in range(60) for v in verbs for z in ("red", "blue")
    ] + ["", "   ", "single", "a  b\tc", "99"]


def test_result_does_not_depend_on_order_or_partitioning(spark):
    df = messages(spark, corpus())
    first = mined(mine_templates(df))
    assert first == mined(mine_templates(df.repartition(13).orderBy(F.rand(3))))
    assert sum(n for _, n in first) == len(corpus())


def test_every_message_fits_its_template(spark):
    df = messages(spark, corpus())
    rows = assign_templates(df, assign_signatures(df)).collect()
    assert len(rows) == len(corpus())
    for r in rows:
        words, pattern = r.message.split(), r.template.split()
        assert len(words) == len(pattern)
        assert all(p in ("<*>", w) for w, p in zip(words, pattern))
        assert r.params == [w for w, p in zip(words, pattern) if p == "<*>"]


def test_part_size_does_not_change_the_answer(spark):
    names = [f"{a}{b}{c}" for a in "bcdfghklmn" for b in "aeiou" for c in "bcdfghklmnprst"]
    df = messages(spark, [f"user {n} came in by the south gate" for n in names] + corpus())
    want = mined(mine_templates(df))
    assert ("user <*> came in by the south gate", len(names)) in want
    for part_rows in (10, 100):
        done = assign_signatures(df, part_rows=part_rows)
        assert mined(templates_of(done)) == want
        assert assign_templates(df, done).filter("template is null").count() == 0


def test_unlike_rows_of_a_big_leaf_stay_apart(spark):
    texts = [f"x {a}{b} {b}{a}" for a in "abcdefgh" for b in "ijklmnop"]
    got = mine_templates(messages(spark, texts), similarity=0.9, part_rows=5)
    assert mined(got) == {(t, 1) for t in texts}


def test_a_lone_pair_meets_in_a_big_leaf_of_unlike_rows(spark):
    texts = [f"x {a}{b} {b}{a} {a}{a}{b} {b}{b}{a}" for a in "abcdefghijkl" for b in "mnopqrstuvwx"]
    pair = ["x same and one more", "x same and two more"]
    df = messages(spark, texts + pair)
    want = {(t, 1) for t in texts} | {("x same and <*> more", 2)}
    for part_rows in (5, 40, 5000):
        done = assign_signatures(df, similarity=0.7, part_rows=part_rows)
        assert mined(templates_of(done)) == want
        assert done.count() == len(texts) + 2


def test_no_two_templates_that_could_merge_stay_apart(spark):
    rng = random.Random(3)
    df = messages(spark, [" ".join(["x", *(rng.choice("abcdefgh") + "q" for _ in range(6))]) for _ in range(300)])
    for part_rows in (50, 5000):
        got = [r.template.split() for r in mine_templates(df, similarity=0.6, part_rows=part_rows).collect()]
        same = [sum(a == b != "<*>" for a, b in zip(s, t)) for i, s in enumerate(got) for t in got[:i]]
        assert max(same) < 0.6 * 7


def test_ids_outlive_generalisation(spark):
    first = mine_templates(messages(spark, ["job alpha done at last", "stop now"]))
    old = {r.template: r.template_id for r in first.collect()}
    second = mine_templates(messages(spark, ["job beta done at last", "other text here"]), seeds=first)
    new = {r.template: r.template_id for r in second.collect()}
    assert new["job <*> done at last"] == old["job alpha done at last"]
    assert new["stop now"] == old["stop now"] and len(new) == 3
    logs = messages(spark, ["job beta done at last", "other text here"])
    rows = assign_templates(logs, assign_signatures(logs, seeds=first))
    assert [r.template for r in new_patterns(rows, first).collect()] == ["other text here"]


def test_merged_templates_keep_all_their_ids(spark):
    apart = mine_templates(messages(spark, ["job a b c", "job d e f"]))
    both = mine_templates(messages(spark, ["job a b f"]), seeds=apart, similarity=0.25)
    known = {r.template_id: r.current_id for r in current_ids(both).collect()}
    assert {r.template_id for r in apart.collect()} <= set(known)


def test_hot_keys_join_without_shuffle_and_keep_all_rows(spark):
    big = spark.range(2000).select(F.when(F.col("id") < 1500, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    small = big.groupBy("k").agg(F.count("*").alias("w")).withColumn("v", F.concat("k", F.lit("!")))
    got = join_by_weight(big, small, ["k"], "w", share=10)
    assert got.count() == 2000
    assert got.filter(F.col("v") == F.concat("k", F.lit("!"))).count() == 2000


def test_signature_marks_whole_words(spark):
    df = spark.createDataFrame([("a1 b c2d  x=3, é 9",)], "m string")
    assert df.select(signature(F.col("m"))).first()[0] == "<*> b <*>  <*> é <*>"


def test_groups_stream_through_tasks(spark):
    """No call for each leaf, and leaves that go over several Arrow batches stay whole."""
    rows = [(f"2 L{i % 40}", i % 3, f"L{i % 40} w{i}", i % 5 + 1) for i in range(400)]
    df = spark.createDataFrame(rows, "leaf string, part bigint, text string, weight bigint").withColumns(
        {"ids": F.array().cast("array<string>"), "parts": F.lit(1).cast("bigint")}
    )
    found = templates._clustered(df, 0.5)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    whole = {tuple(r) for r in found.select("leaf", "text", "template", "weight").collect()}
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "2")
    try:
        assert whole == {tuple(r) for r in templates._clustered(df, 0.5).select("leaf", "text", "template", "weight").collect()}
    finally:
        spark.conf.set(size, before)
    members: dict = {}
    for leaf, part, text, _ in rows:
        members.setdefault((leaf, part), []).append(text)
    template = {(leaf, text): t for leaf, text, t, _ in whole}
    for (leaf, _), texts in members.items():
        want = f"{leaf[2:]} <*>" if len(texts) > 1 else texts[0]
        assert {template[leaf, t] for t in texts} == {want}
    assert len(whole) == len(rows)


def test_mining_leaves_one_compact_table(spark):
    """Tables and shuffle files of the way there are removed; a template that is the signature is not stored again."""
    texts = corpus() + [f"only {a}{b} here" for a in "abcdefgh" for b in "ijklmnop"]
    shared = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    before, setting = set(shared.glob("*")), spark.conf.get(REMOVE_SHUFFLES, None)
    for seeds in (None, mine_templates(messages(spark, FOUR)).localCheckpoint()):
        before = set(shared.glob("*"))
        for part_rows in (5000, 7):
            done = assign_signatures(messages(spark, texts), similarity=0.9, seeds=seeds, part_rows=part_rows)
            (left,) = set(shared.glob("*")) - before
            before.add(left)
            stored = spark.read.parquet(str(left))
            assert stored.filter("sig = template").count() == 0 and stored.filter("template IS NULL").count() >= 64
            assert done.filter("template IS NULL OR template_id IS NULL OR former IS NULL").count() == 0
            assert done.agg(F.sum("weight")).first()[0] == len(texts) + (len(FOUR) if seeds is not None else 0)
    assert spark.conf.get(REMOVE_SHUFFLES, None) == setting


def test_signatures_put_constant_digit_words_back(spark):
    rng = random.Random(8)
    words = ["a", "b", "x1", "x2", "7", "<*>", "q", "é9"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4]))) for _ in range(400)]
    texts += ["port 80 open", "port 80 shut", "port 80 open", "  port\t81   wide ", *[f"v{i} of 9" for i in range(5)], ""]
    held: dict = {}
    for t in (" ".join(x.split()) for x in texts):
        held.setdefault(" ".join("<*>" if any(c.isdigit() for c in w) else w for w in t.split(" ")), []).append(t.split(" "))
    want = set()
    for sig, rows in held.items():
        found = [{r[i] for r in rows if any(c.isdigit() for c in r[i])} for i in range(len(rows[0]))]
        want.add((sig, " ".join(min(f) if len(f) == 1 else w for f, w in zip(found, sig.split(" "), strict=True)), len(rows)))
    assert {tuple(r) for r in templates._signatures(messages(spark, texts), "message").collect()} == want
