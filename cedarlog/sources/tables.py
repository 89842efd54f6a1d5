"""Stored tables: logs, catalog, chat history, documents, templates, golden sets."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cedarlog import schema
from cedarlog.session import materialise
from cedarlog.sources.lines import path_exists


def write_logs(df: DataFrame, path: str, load_id: str | None = None) -> None:
    """Add log rows as Parquet by ``load_id`` and ``log_date``.

    Batches and streams share this layout: each load owns a folder, and a load that is repeated under
    its id replaces that folder as a whole. Without an id a new one is made. The rebalance hint lets
    adaptive execution split a day that is too big for one writer and merge days that are small.
    """
    ready = df if "log_date" in df.columns else df.withColumn("log_date", F.to_date("timestamp"))
    (
        ready.drop("load_id").hint("rebalance", "log_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("log_date")
        .parquet(f"{path}/load_id={load_id or uuid.uuid4().hex}")
    )


def read_loads(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all loads with their ``load_id`` and ``log_date``."""
    return spark.read.option("mergeSchema", "false").parquet(path)


def read_logs(spark: SparkSession, path: str, table: T.StructType = schema.LOG_TABLE) -> DataFrame:
    """The log table, or no rows with its schema before the first load."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], table)
    loads = T.StructType([*table.fields, T.StructField("load_id", T.StringType())])
    return spark.read.schema(loads).parquet(path).select(table.fieldNames())


def register_tables(spark: SparkSession, logs_path: str, catalog_path: str | None = None) -> None:
    """Make the stored table ``logs`` and the CSV file ``system_catalog`` known to SQL by these names."""
    read_logs(spark, logs_path).createOrReplaceTempView("logs")
    if catalog_path is not None:
        read_catalog(spark, catalog_path)


def write_logs_by_year(df: DataFrame, path: str) -> None:
    """Stage history by year and day, to be loaded in one go."""
    (
        df.withColumn("log_date", F.to_date("timestamp"))
        .withColumn("log_year", F.year("timestamp"))
        .hint("rebalance", "log_year", "log_date")
        .write.mode("append")
        .partitionBy("log_year", "log_date")
        .parquet(path)
    )


def describe(df: DataFrame) -> DataFrame:
    """``column_name, column_type`` rows of a table."""
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column_name string, column_type string")


#: Kinds and names of plan nodes that do something, and functions that call any code.
_ACTIONS = ("Command", "ParsedStatement")
_ACTING = r"InsertInto|ExecuteImmediate|^Call|CompoundBody|SetVariable"
_CALLS = r"\b(reflect|java_method|try_reflect)\s*\("


def _acts(spark: SparkSession, text: str) -> bool:
    """Whether the text, as Spark's parser reads it, is or holds anything but a query."""
    jvm = spark.sparkContext._jvm
    kinds = [jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{k}") for k in _ACTIONS]
    open_ = [spark._jsparkSession.sessionState().sqlParser().parsePlan(text)]
    while open_:
        node = open_.pop()
        if any(k.isInstance(node) for k in kinds) or re.search(_ACTING, node.nodeName()):
            return True
        children = node.children()
        open_ += [children.apply(i) for i in range(children.size())]
    return bool(re.search(_CALLS, text, re.IGNORECASE))


def run_sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """Run a read-only SQL text over named tables; Spark parses and plans it.

    What the text does is read from its parsed plan: commands and inserts are refused before they run, however
    they begin.
    """
    # Named tables stand in braces, which only their filling in makes SQL.
    if _acts(spark, re.sub("\\{(" + "|".join(map(re.escape, tables)) + ")\\}", r"\1", text) if tables else text):
        raise ValueError("only queries are allowed")
    return spark.sql(text, **tables) if tables else spark.sql(text)


def query_or_error(spark: SparkSession, text: str | None, **tables: DataFrame) -> DataFrame:
    """The result of :func:`run_sql`, or a one-row ``error`` table in place of any failure, also while it runs."""
    if not text:
        message = "Could not understand query. Try 'count errors' or 'show recent logs'."
    else:
        try:
            found = run_sql(spark, text, **tables)
            # Written under plain names: a result may name two columns alike.
            numbered = found.toDF(*[f"c{i}" for i in range(len(found.columns))])
            return materialise(numbered, "answer").toDF(*found.columns)
        except Exception as e:  # the text comes from a user, any refusal becomes a row
            message = f"SQL Execution failed: {e}"
    return spark.createDataFrame([(message,)], "error string")


def read_catalog(spark: SparkSession, path: str, view: str | None = "system_catalog") -> DataFrame:
    """The system catalog from a CSV file with a header."""
    df = spark.read.schema(schema.CATALOG).option("header", True).csv(path)
    if view:
        df.createOrReplaceTempView(view)
    return df


def append_chat(messages: DataFrame, path: str) -> None:
    """Append ``session_id, role, content`` with a new id and the current time."""
    (
        messages.select(
            F.expr("uuid()").alias("id"),
            F.current_timestamp().alias("timestamp"),
            "session_id",
            "role",
            "content",
        )
        .write.mode("append")
        .parquet(path)
    )


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema.CHAT)
    return spark.read.schema(schema.CHAT).parquet(path)


def append_documents(docs: DataFrame, path: str) -> None:
    docs.select(schema.DOCUMENT.fieldNames()).write.mode("append").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The document collection, or an empty one when nothing was stored yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema.DOCUMENT)
    return spark.read.schema(schema.DOCUMENT).parquet(path)


def read_golden(spark: SparkSession, path: str, shape: T.StructType) -> DataFrame:
    """A golden set: one JSON array of objects."""
    return spark.read.schema(shape).option("multiLine", True).json(path)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.RULES).json(path)


def after_cutover(history: DataFrame, live: DataFrame) -> DataFrame:
    """History, followed by the live rows that it does not hold.

    Live rows later than the last history row are new. Times are whole seconds, so live rows of that
    very second may be new too: of each of them as many stay as the history has fewer.
    """
    cut = history.agg(F.max("timestamp")).first()[0]
    if cut is None:
        return history.unionByName(live)
    last = F.col("timestamp") == F.lit(cut)
    # Only the rows of one second are counted.
    new = live.filter(last).exceptAll(history.filter(last).select(live.columns))
    return history.unionByName(live.filter(F.col("timestamp") > F.lit(cut))).unionByName(new)
