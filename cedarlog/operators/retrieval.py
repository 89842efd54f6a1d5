"""Log documents, their vectors, and exact filtered top-k search.

Search makes one pass over the documents. Every Arrow batch is compared with all query vectors
by one matrix product and hands on only its own best k per query, so the shuffle that follows
holds at most k rows per query and batch, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cedarlog.functions.text import tokens

DEFAULT_K = 2
MAX_QUERIES = 1_000
DIMENSIONS = 256


def document_text(context: str = "context") -> Column:
    """Five labelled lines; the time is in UTC."""
    micros = F.date_format("timestamp", "SSSSSS")
    stamp = F.concat(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"),
        F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)),
        F.lit("+00:00"),
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Timestamp: "), stamp),
        F.concat(F.lit("Service: "), "service_name"),
        F.concat(F.lit("Severity: "), "severity"),
        F.concat(F.lit("Message: "), "body"),
        F.concat(F.lit("Context: "), F.coalesce(F.col(context), F.lit("{}"))),
    )


def to_documents(logs: DataFrame, context: str = "context") -> DataFrame:
    """``doc_key, text, metadata, embed_text`` of log rows.

    Metadata holds time, service and severity, and the context keys over them. The text to
    embed leaves the time out.
    """
    base = {
        "timestamp": F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"),
        "service_name": F.col("service_name"),
        "severity": F.col("severity"),
    }
    own = F.coalesce(
        F.from_json(context, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>")
    )
    fixed = F.create_map(*[x for k, v in base.items() for x in (F.lit(k), v)])
    metadata = F.map_concat(
        F.map_filter(fixed, lambda k, _: ~F.map_contains_key(F.col("_own"), k)), F.col("_own")
    )
    return (
        logs.withColumn("_own", own)
        .withColumn("text", document_text(context))
        .withColumn("metadata", metadata)
        .select(
            F.md5("text").alias("doc_key"),
            "text",
            "metadata",
            F.substring_index("text", "\n", -4).alias("embed_text"),
        )
    )


def embed(docs: DataFrame, text: str = "embed_text", dimensions: int = DIMENSIONS) -> DataFrame:
    """Add ``embedding``: hashed word counts at unit length, the default stand-in for a model.

    Any function that adds an ``array<float>`` column of this name can take its place.
    """
    # Between words stands one blank, so that only the ends can give empty ones.
    plain = F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " ")
    words = docs.withColumn("_words", F.array_remove(plain, ""))
    counted = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dimensions).transform(words)
    unit = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(counted)
    return unit.withColumn("embedding", vector_to_array("_unit", "float32")).drop(
        "_words", "_tf", "_unit"
    )


def one_per_template(logs: DataFrame) -> DataFrame:
    """The earliest row of every template, to index templates in place of lines."""
    first = F.min_by(F.struct(*logs.columns), F.struct("timestamp", "message"))
    return logs.groupBy("template_id").agg(first.alias("r")).select("r.*")


def with_metadata(docs: DataFrame, filters: dict[str, str | list[str]] | None) -> DataFrame:
    """Rows whose metadata has these values, all of them; a list means any of its values."""
    for key, value in (filters or {}).items():
        cell = F.try_element_at("metadata", F.lit(key))
        docs = docs.filter(cell.isin(value) if isinstance(value, list) else cell == value)
    return docs


def _unit_rows(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _best_of_task(queries: np.ndarray, names: list, k: int, least: float | None):
    """A running best ``k`` for each query over all batches of a task; equal ids count once."""

    def search(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best_sims = [np.zeros(0)] * len(names)
        best_ids: list[np.ndarray] = [np.zeros(0, object)] * len(names)
        for pdf in pdfs:
            if pdf.empty:
                continue
            vectors = _unit_rows(np.stack(pdf["embedding"].to_numpy()).astype(np.float64))
            sims = np.round(vectors @ queries.T, 6)
            ids = pdf["id"].to_numpy(dtype=object)
            for q in range(len(names)):
                near = sims[:, q]
                bound = best_sims[q][-1] if len(best_sims[q]) == k else -np.inf
                fit = near >= (bound if least is None else max(bound, least))
                if not fit.any():
                    continue
                pool, pool_ids = np.append(best_sims[q], near[fit]), np.append(best_ids[q], ids[fit])
                order = np.lexsort((pool_ids, -pool))
                _, first = np.unique(pool_ids[order], return_index=True)
                order = order[np.sort(first)][:k]
                best_sims[q], best_ids[q] = pool[order], pool_ids[order]
        for q, name in enumerate(names):
            if len(best_ids[q]):
                yield pd.DataFrame({"query_id": name, "id": best_ids[q], "similarity": best_sims[q]})

    return search


def top_k(
    docs: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_K,
    least: float | None = None,
    id_col: str = "id",
    query_id: str = "query_id",
    max_queries: int = MAX_QUERIES,
) -> DataFrame:
    """``query_id, id, similarity, rank``: the k most similar documents of every query.

    Exact cosine similarity rounded to six digits, equal values by id; rows of one id count once.
    ``least`` is a relevance bound. Queries above ``max_queries`` are taken in hash blocks, one pass
    for each block, so tasks and driver hold one block at a time. A task hands on ``k`` rows per query.
    """
    wanted = queries.select(
        F.col(query_id).alias("query_id"), F.col("embedding").cast("array<double>").alias("v")
    )
    n = wanted.count()
    blocks = -(-n // max(1, max_queries // 2)) if n > max_queries else 1
    pool = docs.select(F.col(id_col).alias("id"), "embedding").filter(F.col("embedding").isNotNull())
    id_type = pool.schema["id"].dataType.simpleString()
    q_type = wanted.schema["query_id"].dataType.simpleString()
    shape = f"query_id {q_type}, id {id_type}, similarity double"
    found = None
    for b in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        matrix = _unit_rows(np.array([r.v for r in rows], dtype=np.float64))
        names = [r.query_id for r in rows]
        part = pool.mapInPandas(_best_of_task(matrix, names, k, least), shape)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], shape + ", rank int")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    once = found.groupBy("query_id", "id").agg(F.max("similarity").alias("similarity"))
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two texts' lower-cased words; 0 when either text has none."""
    left, right = F.array_distinct(tokens(F.lower(a))), F.array_distinct(tokens(F.lower(b)))
    union = F.size(F.array_union(left, right))
    return F.when(
        (F.size(left) > 0) & (F.size(right) > 0),
        F.size(F.array_intersect(left, right)) / union,
    ).otherwise(F.lit(0.0))


def rerank(
    candidates: DataFrame,
    texts: DataFrame,
    query_texts: DataFrame,
    weight: float = 0.7,
    k: int = DEFAULT_K,
) -> DataFrame:
    """Order candidates by a weighted sum of similarity and word overlap with the query text."""
    scored = (
        candidates.join(texts.select("id", "text"), "id")
        .join(query_texts.select("query_id", F.col("text").alias("_q")), "query_id")
        .withColumn(
            "score",
            F.round(weight * F.col("similarity") + (1 - weight) * jaccard(F.col("text"), F.col("_q")), 6),
        )
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        scored.withColumn("new_rank", F.row_number().over(order))
        .filter(F.col("new_rank") <= k)
        .select("query_id", "id", "similarity", "score", F.col("new_rank").alias("rank"))
    )
