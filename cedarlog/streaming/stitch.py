"""Multi-line records of an endless stream of files.

A record may go on in the next file of the same log, and that file may come in a later micro-batch. Records
that begin and end inside one part of a file (what one task reads of it) are joined there. Only what stands
before the first head line of a part and its last record, which may go on, are shuffled: two rows for each part, by
log. The state of a log is its open record. It is closed by the next head line of that log, or by a timer when the
stream has gone on for ``idle`` without a line of the log. What is open after the last micro-batch can be read
from the checkpoint, so closed and open records together are those of the batch :func:`stitch`.

Parts of a log go on in the order of their files' modification time, then name and place in the file. Lines before the
first head of a log form a record without a head, as in the batch form. Lines that come after a timer
closed their record form such a record too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from cedarlog.operators.stitch import is_head
from cedarlog.sources.lines import CURRENT_LOGS
from cedarlog.streaming.state import ARRIVED, millis, stored_state, use_rocksdb, with_arrival

IDLE = "10 minutes"
#: What a fragment is: a whole record, lines before the first head, or a record that may go on.
WHOLE, LEAD, OPEN = "whole", "lead", "open"

_FRAGMENT = (
    "log string, modified timestamp, source_file string, block bigint, nth int, kind string, closes boolean, "
    "value string, n_lines bigint"
)
_RECORD = "log string, source_file string, value string, n_lines bigint"
_OPEN = "source_file string, parts array<string>, n_lines bigint, last bigint"


def log_of(file: Column) -> Column:
    """The log a file belongs to: its name up to ``.log``, without a number before or marks behind it."""
    return F.regexp_replace(file, r"[-_.]?\d*\.log.*$", ".log")


def stream_parts(spark: SparkSession, folder: str, glob: str = CURRENT_LOGS, files_per_batch: int = 1000) -> DataFrame:
    """``value, source_file, path, modified, block`` of the files of a folder as they arrive, oldest first.

    ``folder`` may hold wildcards for folders.
    """
    return (
        spark.readStream.schema(T.StructType([T.StructField("value", T.StringType())]))
        .option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).text(folder)
        .select(
            "value", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_block_start").alias("block"),
        )
    )


class _Part:
    """The lines of one part as they come; knows the record at hand only."""

    def __init__(self, where: tuple):
        self.where, self.lines, self.headed, self.nth = where, [], False, -1

    def _cut(self, kind: str, closes: bool = False) -> tuple:
        lines, self.lines, self.nth = self.lines, [], self.nth + 1
        return (*self.where, self.nth, kind, closes, "\n".join(lines) if lines else None, len(lines))

    def head(self) -> tuple:
        """What a head line completes: the record before, or what stood before the first head of the part."""
        done = self._cut(WHOLE) if self.headed else self._cut(LEAD, True)
        self.headed = True
        return done

    def end(self) -> tuple:
        return self._cut(OPEN) if self.headed else self._cut(LEAD)


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the lines of each part into fragments; holds one record and one Arrow batch at a time."""
    part, schema = None, None

    def rows(found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found, strict=True) if found else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        schema = schema or pa.schema([
            ("log", pa.string()), ("modified", batch.schema.field("modified").type), ("source_file", pa.string()),
            ("block", pa.int64()), ("nth", pa.int32()), ("kind", pa.string()), ("closes", pa.bool_()),
            ("value", pa.string()), ("n_lines", pa.int64()),
        ])
        out: list[tuple] = []
        columns = [batch[c].to_pylist() for c in ("log", "modified", "source_file", "block", "head", "value")]
        for *where, head, value in zip(*columns, strict=True):
            if part is None or part.where != tuple(where):
                if part is not None:
                    out.append(part.end())
                part = _Part(tuple(where))
            if head:
                out.append(part.head())
            part.lines.append(value)
        yield rows(out)
    if part is not None:
        yield rows([part.end()])


def fragments(lines: DataFrame, head: Column | None = None, log: Column | None = None) -> DataFrame:
    """The lines of files as whole records and as fragments that may belong together."""
    marked = lines.select(
        (log_of(F.col("source_file")) if log is None else log).alias("log"), "modified", "source_file", "block",
        (is_head(F.col("value")) if head is None else head).alias("head"), "value",
    )
    return marked.mapInArrow(_fragments, _FRAGMENT)


class OpenRecord(StatefulProcessor):
    """The record of a log that may still go on."""

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)

    def handleInputRows(self, key, rows, timerValues):
        file, parts, n, last = self.open.get() if self.open.exists() else (None, [], 0, None)
        parts, before = list(parts), last
        # Two rows for each part of the log that this micro-batch holds.
        for r in sorted(rows, key=lambda r: (r.modified, r.source_file, r.block, r.nth)):
            if r.kind == LEAD:
                if r.n_lines:
                    file, n = file or r.source_file, n + r.n_lines
                    parts.append(r.value)
                if r.closes and n:
                    yield Row(log=key[0], source_file=file, value="\n".join(parts), n_lines=n)
                    file, parts, n = None, [], 0
            else:
                file, parts, n = r.source_file, [r.value], r.n_lines
            last = max(last or 0, millis(r[ARRIVED]))
        if before is not None and before != last:
            self.handle.deleteTimer(before)
        if n:
            self.open.update((file, parts, n, last))
            if before != last:
                self.handle.registerTimer(last)
        else:
            self.open.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.open.exists():
            file, parts, n, _ = self.open.get()
            self.open.clear()
            yield Row(log=key[0], source_file=file, value="\n".join(parts), n_lines=n)


def stitch_stream(lines: DataFrame, head: Column | None = None, log: Column | None = None, idle: str = IDLE) -> DataFrame:
    """``log, source_file, value, n_lines``: the records of ``lines`` (as :func:`stream_parts` gives them) once they are complete.

    ``source_file`` is the file of the record's first line. Whole records pass without a shuffle.
    """
    use_rocksdb(lines.sparkSession)
    whole = fragments(lines, head, log).filter(F.col("kind") == WHOLE).select("log", "source_file", "value", "n_lines")
    rest = with_arrival(fragments(lines, head, log).filter(F.col("kind") != WHOLE), idle)
    joined = rest.groupBy("log").transformWithState(OpenRecord(), _RECORD, "Append", "EventTime")
    return whole.unionByName(joined)


def open_records(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``log, source_file, value, n_lines`` of the records that may still go on after the last micro-batch."""
    return stored_state(spark, checkpoint, "open").select(
        F.col("key.log").alias("log"), F.col("value.source_file").alias("source_file"),
        F.array_join("value.parts", "\n").alias("value"), F.col("value.n_lines").alias("n_lines"),
    )
