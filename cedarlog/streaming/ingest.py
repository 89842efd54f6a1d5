"""Continuous loading into two sinks with replay but without duplicates."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cedarlog.operators.queries import error_rate
from cedarlog.operators.retrieval import embed, to_documents
from cedarlog.operators.templates import (
    assign_signatures,
    assign_templates,
    templates_of,
)
from cedarlog.plans.ingest import as_log_table, save_next, structure, with_rule_fields, with_signatures
from cedarlog.schema import DOCUMENT
from cedarlog.session import scratch_scope
from cedarlog.sources.lines import path_exists
from cedarlog.sources.tables import write_logs
from cedarlog.streaming.stitch import IDLE, stitch_stream

#: Loads of a stream are named so, with the number of the batch.
STREAM = "stream-"


def dual_sink(logs_path: str, documents_path: str | None = None):
    """Writer of one micro-batch to both sinks.

    Each batch is a load of the ``logs`` table of its own, and has a folder in the document sink. It
    replaces both as a whole, so a batch that is repeated after a failure between the two writes adds
    nothing, even if its rows now fall on other days. Documents are made from the log rows as stored, so lines
    are parsed once and a big batch is not kept in memory.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        load = f"{STREAM}{batch_id}"
        write_logs(batch, logs_path, load)
        if documents_path is not None:
            stored = batch.sparkSession.read.schema(batch.schema).parquet(f"{logs_path}/load_id={load}")
            docs = embed(to_documents(stored)).select(DOCUMENT.fieldNames())
            docs.write.mode("overwrite").parquet(f"{documents_path}/batch_id={batch_id}")

    return write


def arrival_year(line: Column) -> Column:
    """The year of a line without one, by when it came: a month still to come this year was last year's."""
    month = F.ceil(F.instr(F.lit("JanFebMarAprMayJunJulAugSepOctNovDec"), F.substring(F.ltrim(line), 1, 3)) / 3)
    now = F.current_timestamp()
    return F.year(now) - F.when(month > F.month(now), 1).otherwise(0)


def start_ingest(
    lines: DataFrame,
    logs_path: str,
    checkpoint: str,
    default_year: int | None = None,
    ingest_ts: str | None = None,
    documents_path: str | None = None,
    every: str | None = None,
    multiline: bool = False,
    idle: str = IDLE,
    rules: DataFrame | None = None,
):
    """Start loading a line stream; without ``every`` it stops when the input is used up.

    Without ``default_year`` and ``ingest_ts`` each micro-batch takes the time it came, so a stream may run over
    years. ``multiline`` takes lines as :func:`stream_parts` gives them and joins those that begin no record to the record
    before, also over micro-batches; a record waits up to ``idle`` for more lines. ``rules`` are tried before the
    general parser on the lines of their service, which the file name up to ``.log`` tells.
    """
    if multiline:
        lines = stitch_stream(lines, idle=idle).select("value", "source_file")
    lines = lines.select("value", "source_file")
    if rules is not None:
        lines = with_rule_fields(lines, rules, F.regexp_replace("source_file", r"[-_.]?\d*\.log.*$", ""))
    year = arrival_year(F.col("value")) if default_year is None else default_year
    now = F.current_timestamp() if ingest_ts is None else ingest_ts
    rows = with_signatures(structure(lines, year, now))
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        dual_sink(logs_path, documents_path)
    )
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return writer.trigger(**trigger).start()


def evolve_templates(templates_path: str, logs_path: str, **options):
    """Batch writer that mines with the templates known so far and saves the merged set.

    The set of batch ``n`` is version ``n``; a repeated batch starts from version ``n-1`` and
    writes the same version again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        known = load_templates_before(spark, templates_path, batch_id)
        kept = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            with scratch_scope(spark):
                assignment = assign_signatures(kept, "message", seeds=known, **options)
                write_logs(as_log_table(assign_templates(kept, assignment)), logs_path, f"{STREAM}{batch_id}")
                save_next(templates_of(assignment), templates_path, batch_id)
        finally:
            kept.unpersist()

    return write


def load_templates_before(spark, path: str, version: int) -> DataFrame | None:
    """The newest set with a version below ``version``."""
    if not path_exists(spark, path):
        return None
    stored = spark.read.parquet(path).filter(F.col("version") < version)
    newest = stored.agg(F.max("version")).first()[0]
    return None if newest is None else stored.filter(F.col("version") == newest).drop("version")


def streaming_error_rate(logs: DataFrame, late: str = "1 hour", every: str = "1 hour") -> DataFrame:
    """Error share per period of a stream; rows later than ``late`` are past the watermark."""
    return error_rate(logs.withWatermark("timestamp", late), every)

