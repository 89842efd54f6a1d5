from tests.llm import brute
from tests.llm.conftest import SCHEMA

from cedarlog.llm import line_dedup, near_dedup, substring_dedup


def _distinct_in_order(spark, messy):
    """Distinct (id, text), null id first, then id, then the hash that the operators order by."""
    from pyspark.sql import functions as F

    rows = messy.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).distinct().collect()
    return [(r[0], r[1]) for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))]


def _compare(out, rows, want, count):
    expected = {(i, t): w for (i, t), w in zip(rows, want, strict=True)}
    got = out.collect()
    assert len(got) == count
    for r in got:
        n, lost, kept = expected[(r["row"]["doc_id"], r["row"]["text"])]
        assert (r[1], r[2], r["kept_text"] or "") == (n, lost, kept), r


def test_line_dedup_equals_brute_force(spark, messy):
    rows = _distinct_in_order(spark, messy)
    for min_lines, min_chars in ((3, 60), (2, 10_000), (5, 40), (1, 1)):
        want = brute.dedup_lines(rows, min_lines, min_chars)
        assert any(w[1] for w in want)
        out = line_dedup.dedup_lines(messy, min_lines=min_lines, min_chars=min_chars)
        _compare(out, rows, want, messy.count())


def test_short_lines_of_a_long_repeated_run_go_with_it(spark):
    two = ["x" * 59, "y" * 59]
    long, short = "z" * 300, "ten chars."
    rows = [(1, "\n".join(["a", *two, "b", long, short, "c"])), (2, "\n".join(["d", *two, "e"])), (3, "\n".join([long, short, "f"])),
            (4, "\n".join(["g", short, "h"])), (5, "\n".join(["same"] * 40)), (6, "\n".join(str(i) for i in range(300))), (7, "\n".join(str(i) for i in range(300)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute.dedup_lines(rows, 3, 60)
    _compare(line_dedup.dedup_lines(df), rows, want, len(rows))
    assert [w[1] for w in want] == [0, 2, 2, 0, 39, 0, 300]


def test_line_dedup_stage_keeps_columns_and_clean_documents(spark, messy):
    out = line_dedup.clean(messy)
    assert out.columns == messy.columns
    lost = {r["doc_id"] for r in messy.collect()} - {r["doc_id"] for r in out.collect()}
    rows = _distinct_in_order(spark, messy)
    want = brute.dedup_lines(rows, line_dedup.MIN_LINES, line_dedup.MIN_CHARS)
    only_copies = {i for (i, _), w in zip(rows, want, strict=True) if w[0] and w[0] == w[1]}
    assert lost <= only_copies
    assert all(r["n_chars"] == len(r["text"] or "") for r in out.filter("doc_id < 60 and _id is not null").collect())


def test_substring_dedup_equals_brute_force(spark, messy):
    rows = _distinct_in_order(spark, messy)
    want = brute.dedup_words(rows, substring_dedup.WINDOW)
    assert sum(w[1] > 0 for w in want) > 10
    _compare(substring_dedup.dedup_substrings(messy), rows, want, messy.count())


def test_substring_dedup_does_not_depend_on_batches(spark, messy):
    rows = _distinct_in_order(spark, messy)
    want = brute.dedup_words(rows, substring_dedup.WINDOW)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        _compare(substring_dedup.dedup_substrings(messy.coalesce(1)), rows, want, messy.count())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_near_classes_equal_brute_force(spark, messy):
    rows = _distinct_in_order(spark, messy)
    found = brute.near_classes(rows)
    want = {r: rows[c][0] for r, c in zip(rows, found, strict=True)}
    sizes = {r: found.count(c) for r, c in zip(rows, found, strict=True)}
    labels = near_dedup.classes(messy).join(
        messy.select(*near_dedup.doc_key(), "text").distinct(), ["_text_hash"]
    )
    got = near_dedup.classes(messy).count()
    assert got == len(rows)
    out = near_dedup.label(messy).collect()
    assert len(out) == messy.count() and labels.count() >= len(rows)
    from collections import Counter

    texts = Counter((r["doc_id"], r["text"]) for r in messy.collect())
    expected = Counter()
    for r, n in texts.items():
        expected[(r[0], want[r], sizes[r])] += n
    assert Counter((r["id"], r["class_id"], r["class_size"]) for r in out) == expected


def test_one_document_of_each_class_stays(spark, messy):
    rows = _distinct_in_order(spark, messy)
    out = near_dedup.drop_near_copies(messy)
    assert out.columns == messy.columns
    assert out.count() == len(set(brute.near_classes(rows)))


def test_a_chain_of_near_copies_is_one_class(spark):
    import random

    from tests.llm.conftest import sentence

    words = sentence(random.Random(1), 200).split()
    rows = []
    for i in range(12):  # each one is near its neighbours, the ends are far apart
        rows.append((i, " ".join(words)))
        words[i * 15] = f"new{i}"
        words[i * 15 + 7] = f"other{i}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["class_id"] for r in near_dedup.label(docs).collect()} == {0}


def test_empty_tables(spark, empty):
    assert line_dedup.dedup_lines(empty).count() == 0
    assert substring_dedup.dedup_substrings(empty).count() == 0
    assert near_dedup.label(empty).count() == 0
    assert near_dedup.drop_near_copies(empty).columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_hot_groups(spark):
    """A third of all rows are copies, another third share a passage."""
    import random

    from tests.llm.conftest import sentence

    rng = random.Random(9)
    copy, passage = sentence(rng, 80), sentence(rng, 40)
    rows = [(i, copy) for i in range(300)]
    rows += [(300 + i, f"{sentence(rng, 30)}\n{passage}\n{sentence(rng, 30)}") for i in range(300)]
    rows += [(600 + i, sentence(rng, 60)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    out = substring_dedup.dedup_substrings(docs).select("row.doc_id", "n_removed", "kept_text").collect()
    want = brute.dedup_words(rows, substring_dedup.WINDOW)
    assert {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in out} == {
        i: (w[1], w[2]) for (i, _), w in zip(rows, want, strict=True)
    }
    labels = {r["id"]: r["class_id"] for r in near_dedup.label(docs).collect()}
    assert all(labels[i] == 0 for i in range(300)) and all(labels[i] == i for i in range(300, 900))
    lines = line_dedup.dedup_lines(docs).select("row.doc_id", "n_removed").collect()
    want = brute.dedup_lines(rows, line_dedup.MIN_LINES, line_dedup.MIN_CHARS)
    assert {r[0]: r[1] for r in lines} == {i: w[1] for (i, _), w in zip(rows, want, strict=True)}
