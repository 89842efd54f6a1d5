"""From log rows to the document collection, and questions against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cedarlog.operators.retrieval import (
    DEFAULT_K,
    embed,
    one_per_template,
    to_documents,
    top_k,
    with_metadata,
)
from cedarlog.operators.joins import broadcast_if_small
from cedarlog.session import materialise
from cedarlog.sources.tables import append_documents, read_documents


def index_logs(
    logs: DataFrame, path: str, limit: int | None = None, per_template: bool = False
) -> None:
    """Turn log rows into documents with vectors and append them.

    ``limit`` takes the oldest rows in a fixed order; ``per_template`` one row of each template.
    """
    rows = one_per_template(logs) if per_template else logs
    if limit is not None:
        rows = rows.orderBy("timestamp", "body", "message").limit(limit)
    append_documents(embed(to_documents(rows)), path)


def ask(
    spark: SparkSession,
    path: str,
    questions: DataFrame,
    filters: dict[str, str | list[str]] | None = None,
    k: int = DEFAULT_K,
    least: float | None = None,
) -> DataFrame:
    """Best documents for ``query_id, question`` rows, among those that pass the filters.

    Equal documents were stored once for each log row; they count once. The search comes first, and
    texts are fetched only for what it found: keys are hashes of texts, so any row of a key will do.
    """
    docs = with_metadata(read_documents(spark, path), filters)
    vectors = embed(questions, "question").select("query_id", "embedding")
    best = materialise(top_k(docs, vectors, k, least, id_col="doc_key"), "answers")
    found = broadcast_if_small(best.select(F.col("id").alias("doc_key")).distinct())
    texts = docs.join(found, "doc_key", "left_semi").groupBy(F.col("doc_key").alias("id")).agg(
        F.any_value("text").alias("text")
    )
    return best.join(texts, "id")
