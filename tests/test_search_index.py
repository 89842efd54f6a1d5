"""Inverted index with BM25, fusion of rankings, and the vector store with pruned cells."""

import math
import pathlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cedarlog.operators import keywords as kw
from cedarlog.operators import vector_store as vs
from cedarlog.operators.retrieval import top_k
from cedarlog.session import shared_dir


def _words(text):
    return [w for w in re.sub(r"[\W_]+", " ", text or "").lower().split(" ") if w]


def bm25(docs, queries, k):
    held = {i: Counter(_words(t)) for i, t in docs}
    size = {i: sum(c.values()) for i, c in held.items()}
    n, mean = len(docs), max(sum(size.values()), 1) / max(len(docs), 1)
    df = Counter(w for c in held.values() for w in c)
    out = []
    for q, text in queries:
        scores = {}
        for w in set(_words(text)):
            idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
            for i, c in held.items():
                if c[w]:
                    scores[i] = scores.get(i, 0) + idf * c[w] * (kw.K1 + 1) / (c[w] + kw.K1 * (1 - kw.B + kw.B * size[i] / mean))
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]
        out += [(q, i, round(s, 4), r + 1) for r, (i, s) in enumerate(best)]
    return sorted(out)


def _corpus(seed=4, n=300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(n):
        size = rng.choice([0, 1, 3, 20, 80])
        docs.append((i, " ".join("the" if rng.random() < 0.3 else vocabulary[int(rng.paretovariate(0.7)) % 400] for _ in range(size))))
    docs += [(n, None), (n + 1, ""), (n + 2, "..."), (n + 3, "The THE the, Über-Größe 42"), (n + 4, docs[3][1]), (n + 5, "rareword the " * 30)]
    return docs


def _found(df):
    return sorted((r.query_id, r.id, round(r.score, 4), r.rank) for r in df.collect())


@pytest.mark.parametrize("block", [128, 4])
def test_search_equals_scoring_every_document(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(kw, "BLOCK", block)
    docs = _corpus()
    df = spark.createDataFrame(docs, "id long, text string")
    path = f"{tmp_path}/index"
    kw.add_to_index(df.filter("id < 200"), path, load="one")
    kw.add_to_index(df.filter("id >= 200"), path, load="two")
    kw.add_to_index(df.filter("id >= 200"), path, load="two")  # a load that is repeated
    queries = [(0, "the"), (1, "rareword the w1 w2 w3"), (2, "w7 w11 w250 w399 the w1"), (3, "größe ÜBER"), (4, ""), (5, None),
               (6, "nowhere"), (7, "the the w5 w5"), (8, " ".join(f"w{i}" for i in range(60)) + " the")]
    asked = spark.createDataFrame(queries, "query_id long, text string")
    for k in (1, 3, 10):
        assert _found(kw.search(spark, path, asked, k)) == bm25(docs, queries, k)


def test_words_are_counted_within_a_row_and_rows_of_one_id_together(spark, tmp_path):
    docs = spark.createDataFrame([(1, "b a b, B"), (2, "a c"), (2, "c a"), (3, None), (4, "..."), (5, "c")], "id long, text string")
    counted = kw._counted(docs, "id", "text").orderBy("id", "len").collect()
    assert [(r.id, r.len, [tuple(t) for t in r.terms or []]) for r in counted if r.id in (1, 5)] == [(1, 4, [("a", 1), ("b", 3)]), (5, 1, [("c", 1)])]
    found = {(r.id, r.len, r.term): r.tf for r in kw._postings(kw._counted(docs, "id", "text")).collect()}
    assert found == {(1, 4, "a"): 1, (1, 4, "b"): 3, (2, 2, "a"): 2, (2, 2, "c"): 2, (5, 1, "c"): 1}
    kw.add_to_index(docs, f"{tmp_path}/index", load="one")
    assert spark.read.parquet(f"{tmp_path}/index/sizes").select("docs", "words").first() == (6, 9)


def test_bounds_leave_out_blocks(spark, tmp_path, monkeypatch):
    """A frequent word next to a rare one brings no candidates of its own."""
    monkeypatch.setattr(kw, "BLOCK", 16)
    docs = _corpus(5, 600)
    path = f"{tmp_path}/index"
    kw.add_to_index(spark.createDataFrame(docs, "id long, text string"), path)
    seen = []
    keep = kw.materialise
    monkeypatch.setattr(kw, "materialise", lambda df, name: seen.append((name, out := keep(df, name))) or out)
    found = kw.search(spark, path, spark.createDataFrame([(1, "rareword the")], "query_id long, text string"), 1)
    assert _found(found) == bm25(docs, [(1, "rareword the")], 1)
    assert dict(seen)["candidates"].count() < 20


def test_index_of_nothing(spark, tmp_path):
    path = f"{tmp_path}/index"
    kw.add_to_index(spark.createDataFrame([], "id long, text string"), path)
    assert kw.search(spark, path, spark.createDataFrame([(1, "a")], "query_id long, text string")).count() == 0


def test_index_is_small_and_leaves_nothing_behind(spark, tmp_path):
    """Postings are not shuffled or kept beside the index, which is smaller than its texts."""
    docs = _corpus(6, 3000)
    df = spark.createDataFrame(docs, "id long, text string").coalesce(8)
    shared = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.glob("*"))
    kw.add_to_index(df, f"{tmp_path}/index", load="one")
    assert set(shared.glob("*")) == before
    stored = sum(p.stat().st_size for p in (tmp_path / "index" / "postings").rglob("*.parquet"))
    rows = spark.read.parquet(f"{tmp_path}/index/postings")
    held = rows.agg(F.sum(F.octet_length("numbers") + F.octet_length("tfs"))).first()[0]
    postings = sum(len(set(_words(t))) for _, t in docs)
    assert held <= 4 * postings
    assert stored < 200_000 + 20 * postings


def test_segments_hold_blocks_of_similar_frequency_and_all_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kw, "SEGMENT", 50)
    monkeypatch.setattr(kw, "TEXT_ROWS", 10)
    monkeypatch.setattr(kw, "BLOCK", 16)
    docs = [*_corpus(7, 400), (1000, "many " * 70_000 + "few")]
    kw.add_to_index(spark.createDataFrame(docs, "id long, text string"), f"{tmp_path}/index", load="one")
    rows = spark.read.parquet(f"{tmp_path}/index/postings").collect()
    ids, found, parts = {}, {}, {}
    for r in rows:
        if r.term is None:
            ids[r.segment] = list(zip(r.ids, np.frombuffer(r.lens, "<u4"), strict=True))
            assert r.ids == sorted(r.ids)
    assert len(ids) > 8 and sorted(i for x in ids.values() for i, _ in x) == sorted(i for i, _ in docs)
    for r in rows:
        if r.term is not None:
            tf = np.frombuffer(r.tfs, f"<u{len(r.tfs) // r.n}").tolist()
            at = [ids[r.segment][j] for j in np.frombuffer(r.numbers, "<u2")]
            assert len(at) == r.n <= 16 and max(tf) == r.max_tf and min(n for _, n in at) == r.min_len
            found.update({(i, r.term): f for (i, _), f in zip(at, tf, strict=True)})
            parts.setdefault((r.segment, r.term), []).append((max(tf), min(tf)))
    assert found == {(i, w): f for i, t in docs for w, f in Counter(_words(t)).items()}
    for of in parts.values():
        of.sort(reverse=True)
        assert all(low >= high for (_, low), (high, _) in zip(of, of[1:]))


def test_rows_of_one_id_add_up_over_loads_and_queries_go_in_passes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kw, "MAX_QUERIES", 2)
    one, two = [(1, "a b c"), (2, "a a"), (3, "d e f")], [(2, "a b"), (4, "a d"), (4, "b d d"), (5, "")]
    for name, rows in (("one", one), ("two", two)):
        kw.add_to_index(spark.createDataFrame(rows, "id long, text string"), f"{tmp_path}/index", load=name)
    parts = [*one, *two]
    asked = [(q, t) for q, t in enumerate(["a", "b d", "a b c d e f", "nothing", "f a", "c"])]
    scores = {}
    for q, j, s, _ in bm25([(j, t) for j, (_, t) in enumerate(parts)], asked, 99):
        scores[q, parts[j][0]] = scores.get((q, parts[j][0]), 0) + s
    found = kw.search(spark, f"{tmp_path}/index", spark.createDataFrame(asked, "query_id long, text string"), 10).collect()
    assert {(r.query_id, r.id) for r in found} == set(scores) and len(found) == len(scores)
    assert all(abs(r.score - scores[r.query_id, r.id]) < 3e-4 for r in found)
    best = kw.search(spark, f"{tmp_path}/index", spark.createDataFrame(asked, "query_id long, text string"), 1).collect()
    assert {(r.query_id, r.id) for r in best} == {(r.query_id, r.id) for r in found if r.rank == 1}


def test_ids_that_are_texts(spark, tmp_path):
    docs = [(f"d{i % 7}{i}é" if i % 2 else f"D{i}", t) for i, t in _corpus(8, 120)]
    kw.add_to_index(spark.createDataFrame(docs, "id string, text string"), f"{tmp_path}/index")
    queries = [("q", "the w1 w2"), ("r", "rareword the")]
    assert _found(kw.search(spark, f"{tmp_path}/index", spark.createDataFrame(queries, "query_id string, text string"), 5)) == bm25(docs, queries, 5)


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, id long, rank int")
    got = [tuple(r) for r in kw.fuse(a, b, k=2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 11, round(1 / 61 + 1 / 62, 9), 1), (1, 10, round(1 / 61, 9), 2), (2, 10, round(1 / 61, 9), 1)]


# ---------------------------------------------------------------- vector store


def _vectors(n=900, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 1, (9, dim))
    rows = []
    for i in range(n):
        v = centers[0] if i % 3 == 0 else centers[i % 9] + rng.normal(0, 0.08, dim)  # a third is one and the same
        rows.append((i, [float(x) for x in v], "ab"[i % 2]))
    rows += [(n, [0.0] * dim, "a"), (n + 1, [0.0] * dim, "b"), (n + 2, None, "a"), (5, rows[7][1], "a"), (5, rows[5][1], "a")]
    return rows


def _same(a, b):
    key = lambda df: sorted((r.query_id, r.id, r.similarity, r.rank) for r in df.collect())
    assert key(a) == key(b)


@pytest.mark.parametrize("part", [4096, 50])
def test_pruned_search_equals_full_search(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(vs, "PART", part)
    monkeypatch.setattr(vs, "QUERIES", max(part // 10, 1))
    docs = spark.createDataFrame(_vectors(), "id long, embedding array<double>, kind string")
    vs.write_store(docs, f"{tmp_path}/store", cells=16)
    asked = docs.filter("id % 10 = 0 or id >= 900").select(F.col("id").alias("query_id"), "embedding").filter("embedding is not null").dropDuplicates(["query_id"])
    for k in (1, 4):
        found, opened = vs.search(spark, f"{tmp_path}/store", asked, k)
        _same(found, top_k(docs, asked, k))
    row = opened.filter("query_id = 10").first()
    assert row["opened"] < row["cells"]
    found, _ = vs.search(spark, f"{tmp_path}/store", asked, 3, F.col("kind") == "b")
    _same(found, top_k(docs.filter("kind = 'b'"), asked, 3))


def test_store_of_few_and_of_nothing(spark, tmp_path):
    for name, rows in (("none", []), ("zero", [(1, [0.0, 0.0])]), ("one", [(1, [1.0, 2.0])])):
        docs = spark.createDataFrame(rows, "id long, embedding array<double>")
        vs.write_store(docs, f"{tmp_path}/{name}", cells=4)
        asked = spark.createDataFrame([(7, [2.0, 1.0]), (8, [0.0, 0.0])], "query_id long, embedding array<double>")
        found, _ = vs.search(spark, f"{tmp_path}/{name}", asked, 2)
        _same(found, top_k(docs, asked, 2))


def test_second_round_hands_on_only_what_reaches_the_first(spark, tmp_path, monkeypatch):
    """Where no cell can be left out, a part still gives no row that the k-th similarity of the nearest cells rules out."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 24)))]
    docs = spark.createDataFrame(rows, "id long, embedding array<float>")
    vs.write_store(docs, f"{tmp_path}/store", cells=8)
    handed, keep = [], vs._rank
    monkeypatch.setattr(vs, "_rank", lambda found, k: handed.append(found.count()) or keep(found, k))
    asked = docs.withColumnRenamed("id", "query_id")
    found, opened = vs.search(spark, f"{tmp_path}/store", asked, 2)
    _same(found, top_k(docs, asked, 2))
    pairs = opened.agg(F.sum("opened")).first()[0]
    assert pairs > 400 * 6 and handed[-1] < 2 * pairs * 0.6


def _brute_nearest(asked, docs, place, least, k):
    out = []
    for i, sims in enumerate(np.round(asked @ docs.T, 6) + 0.0):
        best = {}
        for p, s in zip(place, sims):
            best[p] = max(s, best.get(p, -2.0))
        out += [(i, p, s) for p, s in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k] if s >= least[i]]
    return sorted(out)


@pytest.mark.parametrize("sparse", [1, 64, 10**9])
@pytest.mark.parametrize("repeats", [False, True])
def test_screened_products_give_the_exact_best(monkeypatch, sparse, repeats):
    monkeypatch.setattr(vs, "ROWS", 16)
    monkeypatch.setattr(vs, "COLUMNS", 50)
    monkeypatch.setattr(vs, "SPARSE", sparse)
    rng = np.random.default_rng(6)
    docs = rng.normal(size=(700, 8))
    docs[100:400:2] = docs[3] * rng.uniform(0.5, 2, (150, 1))  # copies of one direction
    docs[400:500] = docs[4] + rng.normal(0, 1e-4, (100, 8))  # nearer to each other than single precision tells
    docs[50:60] = 0.0
    asked = np.concatenate([docs[::9], rng.normal(size=(30, 8)), np.zeros((2, 8))])
    docs, asked = vs._unit(docs), vs._unit(asked)
    place = np.arange(700) // 3 if repeats else np.arange(700)
    for k in (1, 5, 60):
        for least in (np.full(len(asked), -np.inf), rng.uniform(0, 1, len(asked)), np.ones(len(asked))):
            got = sorted(zip(*(x.tolist() for x in vs._nearest(asked, docs, place, least, k)), strict=True))
            want = _brute_nearest(asked, docs, place, least, k)
            assert [x[:2] for x in got] == [x[:2] for x in want]
            assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=2e-6)


def test_vectors_of_two_widths_are_refused():
    import pyarrow as pa

    assert vs._matrix(pa.array([[1.0, 2.0], [3.0, 4.0]]).slice(1)).tolist() == [[3.0, 4.0]]
    with pytest.raises(ValueError):
        vs._matrix(pa.array([[1.0, 2.0], [3.0], [4.0, 5.0, 6.0]]))
