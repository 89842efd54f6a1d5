import numpy as np
from pyspark.sql import functions as F

from cedarlog.operators import retrieval as rt
from cedarlog.plans.knowledge import ask, index_logs
from cedarlog.sources.tables import read_documents


def vectors(spark, array, name):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(array)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>").repartition(4)


def brute(docs, queries, k):
    d = docs / np.linalg.norm(docs, axis=1, keepdims=True)
    q = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    sims = np.round(q.astype(np.float32).astype(float) @ d.T, 4)
    return sims


def test_top_k_is_exact_in_one_pass_and_in_blocks(spark):
    rng = np.random.default_rng(5)
    docs, queries = rng.normal(size=(300, 16)).astype(np.float32), rng.normal(size=(9, 16)).astype(np.float32)
    sims = brute(docs.astype(float), queries.astype(float), 4)
    d, q = vectors(spark, docs, "id"), vectors(spark, queries, "query_id")
    for got in (rt.top_k(d, q, 4), rt.top_k(d, q, 4, max_queries=4)):
        rows = got.collect()
        assert len(rows) == 36
        for i in range(9):
            mine = sorted((r for r in rows if r.query_id == i), key=lambda r: r["rank"])
            assert [r.id for r in mine] == list(np.argsort(-sims[i], kind="stable")[:4])


def test_relevance_bound_and_no_queries(spark):
    d = vectors(spark, np.eye(3, dtype=np.float32), "id")
    q = vectors(spark, np.array([[1, 0.1, 0]], dtype=np.float32), "query_id")
    assert [r.id for r in rt.top_k(d, q, 3, least=0.5).collect()] == [0]
    assert rt.top_k(d, q.filter("query_id < 0"), 3).count() == 0


def test_equal_vectors_rank_by_id(spark):
    d = vectors(spark, np.ones((5, 4), dtype=np.float32), "id")
    q = vectors(spark, np.ones((1, 4), dtype=np.float32), "query_id")
    assert [r.id for r in rt.top_k(d, q).orderBy("rank").collect()] == [0, 1]


def logs(spark):
    return spark.createDataFrame(
        [
            ("2025-11-20 10:00:01", "ERROR", "auth", "Login failed for <*>", '{"user":"x","severity":"HIGH"}', "t1", "a"),
            ("2025-11-20 10:00:02", "INFO", "pay", "Payment processed for <*>", "{}", "t2", "b"),
            ("2025-11-20 10:00:03", "ERROR", "auth", "Disk almost full", None, "t3", "c"),
            ("2025-11-20 10:00:04", "ERROR", "auth", "Disk almost full", None, "t3", "d"),
        ],
        "timestamp string, severity string, service_name string, body string, context string, template_id string, message string",
    ).withColumn("timestamp", F.to_timestamp("timestamp"))


def test_document_text_and_metadata(spark):
    r = rt.to_documents(logs(spark)).orderBy("text").first()
    assert r.text == (
        "Timestamp: 2025-11-20 10:00:01+00:00\nService: auth\nSeverity: ERROR\n"
        'Message: Login failed for <*>\nContext: {"user":"x","severity":"HIGH"}'
    )
    assert r.metadata == {
        "timestamp": "2025-11-20 10:00:01", "service_name": "auth", "severity": "HIGH", "user": "x",
    }
    assert r.embed_text.startswith("Service: auth\n")


def test_store_and_ask_with_filters(spark, tmp_path):
    path = str(tmp_path / "kb")
    assert read_documents(spark, path).count() == 0
    index_logs(logs(spark), path)
    asked = spark.createDataFrame([(1, "disk is full")], "query_id int, question string")
    best = ask(spark, path, asked, k=1).first()
    assert "Disk almost full" in best.text
    only = ask(spark, path, asked, {"service_name": "pay", "severity": "INFO"}, k=5).collect()
    assert len(only) == 1 and "Payment" in only[0].text
    either = ask(spark, path, asked, {"service_name": ["pay", "none"]}, k=5)
    assert either.count() == 1
    index_logs(logs(spark), str(tmp_path / "few"), limit=2)
    assert read_documents(spark, str(tmp_path / "few")).count() == 2
    index_logs(logs(spark), str(tmp_path / "per"), per_template=True)
    assert read_documents(spark, str(tmp_path / "per")).count() == 3
