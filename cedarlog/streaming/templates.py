"""Templates of an endless stream, kept as state by digit signature.

Mining is exact over all rows ever seen, because what it needs of a signature can be added up: how
often it came, and for each digit word the smallest and the largest one, which tell whether the word is constant.
That is the state, one small record per signature in the RocksDB store. Rows of a micro-batch are combined per
Arrow batch first, so a signature that a third of all rows have reaches its state as a few rows. Changed
signatures are written by micro-batch; clustering them gives the same templates as mining all rows at
once, for any batching and after any restart, since a micro-batch replaces what it wrote before.

A signature that was not used for ``retire_after`` is retired by a timer: its state goes, and it is marked in
the written table. Should it come back, it starts anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from cedarlog.operators.templates import assign_known, has_digit, normal_message, signature, templates_of
from cedarlog.session import materialise
from cedarlog.sources.lines import path_exists, remove_folder
from cedarlog.streaming.state import ARRIVED, millis, use_rocksdb, with_arrival

_SLOTS = "pos array<int>, lows array<string>, highs array<string>"
_PART = f"sig string, n bigint, {_SLOTS}"
_CHANGE = f"sig string, n bigint, {_SLOTS}, gone boolean"


def _fold(held: dict[int, tuple[str, str]], pos, lows, highs) -> None:
    """Add the smallest and largest words of some positions to those held."""
    for p, low, high in zip(pos, lows, highs, strict=True):
        old = held.get(p)
        held[p] = (low, high) if old is None else (min(old[0], low), max(old[1], high))


def _slots(held: dict[int, tuple[str, str]]) -> tuple[list[int], list[str], list[str]]:
    pos = sorted(held)
    return pos, [held[p][0] for p in pos], [held[p][1] for p in pos]


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each signature of an Arrow batch."""
    for batch in batches:
        count: dict[str, int] = {}
        held: dict[str, dict] = {}
        for sig, pos, words in zip(*(batch[c].to_pylist() for c in ("sig", "pos", "words")), strict=True):
            count[sig] = count.get(sig, 0) + 1
            _fold(held.setdefault(sig, {}), pos, words, words)
        found = [_slots(held[sig]) for sig in count]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(count, pa.string()), pa.array(count.values(), pa.int64()),
                pa.array([x[0] for x in found], pa.list_(pa.int32())),
                pa.array([x[1] for x in found], pa.list_(pa.string())), pa.array([x[2] for x in found], pa.list_(pa.string())),
            ],
            ["sig", "n", "pos", "lows", "highs"],
        )


def signature_parts(messages: DataFrame, col: str = "message") -> DataFrame:
    """``sig, n, pos, lows, highs``: partial sums by signature, several rows for one that is spread out."""
    message = normal_message(F.col(col))
    slots = F.filter(
        F.transform(F.split("m", " "), lambda t, i: F.struct(i.alias("pos"), t.alias("word"))), lambda x: has_digit(x["word"])
    )
    base = messages.select(signature(message).alias("sig"), message.alias("m")).filter("m IS NOT NULL")
    return base.select("sig", slots.alias("s")).select("sig", "s.pos", F.col("s.word").alias("words")).mapInArrow(_combine, _PART)


class SignatureState(StatefulProcessor):
    """Adds up the parts of a signature; emits the sums whenever they change."""

    def __init__(self, timed: bool):
        self.timed = timed

    def init(self, handle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", f"n bigint, {_SLOTS}, last bigint")

    def handleInputRows(self, key, rows, timerValues):
        n, held, last = 0, {}, None
        if self.sums.exists():
            n, pos, lows, highs, last = self.sums.get()
            _fold(held, pos, lows, highs)
        before = last
        for r in rows:
            n += r.n
            _fold(held, r.pos, r.lows, r.highs)
            if self.timed:
                last = max(last or 0, millis(r[ARRIVED]))
        slots = _slots(held)
        self.sums.update((n, *slots, last))
        if self.timed and last != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(last)
        yield Row(sig=key[0], n=n, pos=slots[0], lows=slots[1], highs=slots[2], gone=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.sums.exists():
            self.sums.clear()
            yield Row(sig=key[0], n=0, pos=[], lows=[], highs=[], gone=True)


def track_templates(messages: DataFrame, path: str, checkpoint: str, col: str = "message",
                    retire_after: str | None = None, every: str | None = None):
    """Start keeping the signatures of a stream of messages at ``path``; without ``every`` it stops when the input is used up."""
    use_rocksdb(messages.sparkSession)
    parts = signature_parts(messages, col)
    timed = retire_after is not None
    if timed:
        parts = with_arrival(parts, retire_after)
    changes = parts.groupBy("sig").transformWithState(
        SignatureState(timed), _CHANGE, "Update", "EventTime" if timed else "None"
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(**({"availableNow": True} if every is None else {"processingTime": every})).start()


def _newest(stored: DataFrame) -> DataFrame:
    """The last written row of each signature, with the ``batch`` that wrote it."""
    return stored.groupBy("sig").agg(
        F.max_by(F.struct("n", "pos", "lows", "highs", "gone"), "batch").alias("r"), F.max("batch").alias("batch")
    ).select("sig", "r.*", "batch")


def tracked_signatures(spark: SparkSession, path: str) -> DataFrame:
    """``sig, n_tokens, sig_tokens, tokens, weight``: the signatures in use, their constant digit words put back."""
    shape = "sig string, n_tokens int, sig_tokens array<string>, tokens array<string>, weight bigint"
    if not path_exists(spark, path):
        return spark.createDataFrame([], shape)
    words = F.split("sig", " ")
    same = F.filter(F.arrays_zip("pos", "lows", "highs"), lambda x: x["lows"] == x["highs"])
    constants = F.map_from_entries(F.transform(same, lambda x: F.struct(x["pos"], x["lows"])))
    return (
        _newest(spark.read.parquet(path)).filter("NOT gone").withColumn("c", constants)
        .select(
            "sig", F.size(words).alias("n_tokens"), words.alias("sig_tokens"),
            F.transform(words, lambda t, i: F.coalesce(F.try_element_at("c", i), t)).alias("tokens"), F.col("n").alias("weight"),
        )
    )


def tracked_assignment(spark: SparkSession, path: str, **options) -> DataFrame:
    """The template of every signature in use, as :func:`assign_signatures` gives it; options as there."""
    return assign_known(tracked_signatures(spark, path), **options)


def tracked_templates(spark: SparkSession, path: str, **options) -> DataFrame:
    """The templates of all messages the stream has seen and not retired, with their sizes."""
    return templates_of(tracked_assignment(spark, path, **options))


def compact_signatures(spark: SparkSession, path: str) -> None:
    """Bring the folders of all micro-batches but the newest into one.

    The newest may still be written again by a restarted stream. The result is written in the place of the newest
    of the old folders before the others go, so a stop in between leaves nothing but rows that count for less.
    """
    batches = sorted(r[0] for r in spark.read.parquet(path).select("batch").distinct().collect())[:-1]
    if len(batches) < 2:
        return
    whole = _newest(spark.read.parquet(path).filter(F.col("batch") <= batches[-1])).drop("batch")
    materialise(whole, "signatures").write.mode("overwrite").parquet(f"{path}/batch={batches[-1]}")
    for b in batches[:-1]:
        remove_folder(spark, f"{path}/batch={b}")
