"""Documents and similarity search."""

from __future__ import annotations

from pyspark.sql import functions as F

from cedarlog.operators import keywords as kw
from cedarlog.operators import retrieval as rt
from cedarlog.operators import vector_store as vs
from cedarlog.operators.templates import with_signature_template
from cedarlog.registry.base import query, sql_stamp, stamp, with_feed
from cedarlog.session import scratch_path
from cedarlog.sources import feed
from cedarlog.sources.lines import spread


def _context():
    return F.to_json(F.struct("user_id", "latency_ms", F.concat(F.lit("S-"), "severity").alias("severity")))


def _log_rows(spark, d):
    e = feed.event_logs(spark, d).withColumn("context", _context())
    body = feed.logs_view(spark, d).select("event_id", "body")
    return e.drop("message").join(body, "event_id")


_CTX = """'{"user_id":' || user_id || ',"latency_ms":' || k || ',"severity":"S-' || severity || '"}'"""
_TEXT = f"""'Timestamp: ' || {sql_stamp('ts')} || '+00:00' || chr(10) || 'Service: ' || service_name || chr(10)
  || 'Severity: ' || severity || chr(10) || 'Message: ' || body || chr(10) || 'Context: ' || {_CTX}"""


@query("log_documents", with_feed(f"SELECT {_TEXT} AS text, md5({_TEXT}) AS doc_key FROM logs"))
def log_documents(spark, d):
    return rt.to_documents(_log_rows(spark, d)).select("text", "doc_key")


@query(
    "document_metadata",
    with_feed(
        f"""SELECT {sql_stamp('ts')} AS timestamp, service_name, 'S-' || severity AS severity, CAST(user_id AS VARCHAR) AS user_id,
        count(*) AS n FROM logs GROUP BY ALL"""
    ),
)
def document_metadata(spark, d):
    docs = rt.to_documents(_log_rows(spark, d))
    get = lambda k: F.try_element_at("metadata", F.lit(k)).alias(k)
    return docs.select(get("timestamp"), get("service_name"), get("severity"), get("user_id")).groupBy(
        "timestamp", "service_name", "severity", "user_id"
    ).agg(F.count("*").alias("n"))


@query(
    "one_per_template",
    with_feed(
        f"""SELECT template, {sql_stamp('ts')} AS ts, message FROM logs
        QUALIFY row_number() OVER (PARTITION BY template ORDER BY logs.ts, message) = 1"""
    ),
)
def one_per_template(spark, d):
    rows = with_signature_template(feed.logs_view(spark, d).select("timestamp", "message"))
    return rt.one_per_template(rows).select("template", stamp().alias("ts"), "message")


def _documents(spark, d):
    """Vectors with the language and source of their document as metadata."""
    vectors = feed.table(spark, d, "embeddings")
    docs = feed.table(spark, d, "documents")
    joined = vectors.join(docs, vectors.vec_id == docs.doc_id)
    return joined.select(
        F.col("vec_id").alias("id"), "embedding", "text", "label",
        F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata"),
    )


def _centroids(spark, d):
    """One query per label: the mean of its vectors."""
    cells = feed.table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding")
    )


_CENTROIDS = """cells AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT label, i, avg(x) AS m FROM cells GROUP BY 1, 2),
queries AS (SELECT CAST(label AS BIGINT) AS query_id, list(m ORDER BY i) AS v FROM means GROUP BY label),
docs AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, text, lang, source FROM embeddings JOIN documents ON doc_id = vec_id)"""


def _top(where: str = "true", k: int = 2, least: str = "") -> str:
    return f"""WITH {_CENTROIDS},
    sims AS (SELECT query_id, id, round(list_cosine_similarity(q.v, d.v), 6) AS similarity FROM queries q, docs d WHERE {where}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM sims {least})
    SELECT query_id, id, similarity, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= {k}"""


@query("topk_cosine", _top(k=10))
def topk_cosine(spark, d):
    return rt.top_k(_documents(spark, d), _centroids(spark, d), 10)


@query("topk_default", _top())
def topk_default(spark, d):
    return rt.top_k(_documents(spark, d), _centroids(spark, d))


@query("topk_filtered", _top("lang = 'en' AND source = 'src1'"))
def topk_filtered(spark, d):
    docs = rt.with_metadata(_documents(spark, d), {"lang": "en", "source": "src1"})
    return rt.top_k(docs, _centroids(spark, d))


@query("topk_in_filter", _top("lang IN ('de', 'fr')", 5))
def topk_in_filter(spark, d):
    docs = rt.with_metadata(_documents(spark, d), {"lang": ["de", "fr"]})
    return rt.top_k(docs, _centroids(spark, d), 5)


@query("topk_threshold", _top(k=20, least="WHERE similarity >= 0.3"))
def topk_threshold(spark, d):
    return rt.top_k(_documents(spark, d), _centroids(spark, d), 20, least=0.3)


@query(
    "hybrid_rerank",
    f"""WITH cand AS ({_top(k=10)}), q AS (SELECT item_id, text FROM benchmark),
    t AS (SELECT q.item_id AS query_id, c.id, c.similarity, d.text AS a, q.text AS b FROM q JOIN cand c ON c.query_id = q.item_id % (SELECT count(DISTINCT label) FROM embeddings)
          JOIN documents d ON d.doc_id = c.id),
    s AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(a), '\\s+'), lambda t: t <> '')) AS x,
          list_distinct(list_filter(string_split_regex(lower(b), '\\s+'), lambda t: t <> '')) AS y FROM t),
    r AS (SELECT query_id, id, similarity, round(0.7 * similarity + (1 - 0.7) * (CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0
          ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END), 6) AS score FROM s)
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM r
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 3""",
)
def hybrid_rerank(spark, d):
    """Every benchmark item with its candidates by vector, ordered anew by shared words."""
    docs = _documents(spark, d)
    found = rt.top_k(docs, _item_vectors(spark, d), 10)
    texts = feed.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return rt.rerank(found, docs, texts, k=3)


def _item_vectors(spark, d):
    """A vector for each benchmark item: the centroid that its number falls on."""
    centroids = _centroids(spark, d).withColumnRenamed("query_id", "label")
    labels = centroids.agg(F.count("*").alias("labels"))
    items = feed.table(spark, d, "benchmark").select("item_id").join(F.broadcast(labels))  # one row
    return items.join(centroids, F.col("item_id") % F.col("labels") == F.col("label")).select(
        F.col("item_id").alias("query_id"), "embedding"
    )


def _keyword_sql(k: int) -> str:
    words = "list_filter(string_split(lower(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: w <> '')"
    return f"""
    wd AS (SELECT doc_id AS id, {words.format("coalesce(text, '')")} AS ws FROM documents),
    size AS (SELECT count(*) AS n, sum(len(ws)) / count(*) AS mean FROM wd),
    tf AS (SELECT id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT id, len(ws) AS l, unnest(ws) AS term FROM wd) GROUP BY 1, 2),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    qt AS (SELECT DISTINCT item_id AS query_id, unnest({words.format("coalesce(text, '')")}) AS term FROM benchmark),
    bm AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {kw.K1 + 1} / (tf + {kw.K1} * ({1 - kw.B} + {kw.B} * l / mean))) AS score
           FROM qt JOIN df USING (term) JOIN tf USING (term), size GROUP BY 1, 2),
    kr AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS INTEGER) AS rank
           FROM bm QUALIFY rank <= {k})"""


def _keyword_index(spark, d) -> str:
    """An index of all documents in two loads, the second of which comes twice."""
    path = scratch_path(spark, "keyword-index")
    docs = feed.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    kw.add_to_index(docs.filter("id % 3 = 0"), path, load="a")
    for _ in range(2):
        kw.add_to_index(docs.filter("id % 3 <> 0"), path, load="b")
    return path


def _items(spark, d):
    return feed.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("keyword_search", f"WITH {_keyword_sql(10)} SELECT query_id, id, round(score, 4) AS score, rank FROM kr")
def keyword_search(spark, d):
    """The ten best documents for every benchmark item by BM25, from the index alone."""
    found = kw.search(spark, _keyword_index(spark, d), _items(spark, d), 10)
    return found.withColumn("score", F.round("score", 4))


@query(
    "hybrid_search",
    f"""WITH {_keyword_sql(20)}, cand AS ({_top(k=20)}),
    vr AS (SELECT item_id AS query_id, id, rank FROM benchmark JOIN cand ON query_id = item_id % (SELECT count(DISTINCT label) FROM embeddings)),
    f AS (SELECT query_id, id, sum(1.0 / ({kw.FUSION} + rank)) AS score FROM (SELECT query_id, id, rank FROM kr UNION ALL SELECT * FROM vr) GROUP BY 1, 2)
    SELECT query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank
    FROM f QUALIFY rank <= 10""",
)
def hybrid_search(spark, d):
    """Keyword candidates and vector candidates of every benchmark item, fused by their ranks."""
    by_words = kw.search(spark, _keyword_index(spark, d), _items(spark, d), 20)
    by_vector = rt.top_k(_documents(spark, d), _item_vectors(spark, d), 20)
    return kw.fuse(by_words, by_vector, k=10).withColumn("score", F.round("score", 6))


def _vector_store(spark, d, docs) -> str:
    path = scratch_path(spark, "vector-store")
    vs.write_store(docs, path, cells=32)
    return path


@query(
    "topk_pruned",
    """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
    sims AS (SELECT a.id AS query_id, b.id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM v a, v b)
    SELECT query_id, id, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INTEGER) AS rank FROM sims
    QUALIFY rank <= 5""",
)
def topk_pruned(spark, d):
    """The nearest vectors of every vector, from the cells each can need."""
    docs = feed.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = docs.select(F.col("id").alias("query_id"), "embedding")
    return vs.search(spark, _vector_store(spark, d, docs), asked, 5)[0]


@query("topk_pruned_filtered", _top("lang IN ('de', 'fr')", 5))
def topk_pruned_filtered(spark, d):
    """The same over stored documents of two languages."""
    docs = _documents(spark, d).withColumn("lang", F.try_element_at("metadata", F.lit("lang")))
    store = _vector_store(spark, d, docs.select("id", "embedding", "lang"))
    return vs.search(spark, store, _centroids(spark, d), 5, F.col("lang").isin("de", "fr"))[0]


@query("embed_hashing")
def embed_hashing(spark, d):
    """Word-hash vectors of all documents, searched with all benchmark items."""
    texts = spread(feed.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    docs = rt.embed(texts, "text")
    asked = rt.embed(
        feed.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "text"
    )
    return rt.top_k(docs, asked, 3)
