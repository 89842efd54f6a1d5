"""Counts per period of a stream, with the rows that came too late counted beside them.

A streaming aggregate drops what is behind its watermark and says nothing. Here each micro-batch compares its
rows with the watermark before it counts: the largest time of all earlier micro-batches less the allowed delay,
which is the watermark Spark would use. A row whose period is closed by it goes to the side output, by source and
hour; the others are counted into their period. A micro-batch writes its partial counts and its largest time as one
folder each, and replaces them when it is repeated, so rows counted and rows late always add up to the input.

Rows without time are late rows of no hour: no period can hold them.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cedarlog.operators.queries import ERROR
from cedarlog.session import materialise
from cedarlog.sources.lines import path_exists, remove_folder

DELAY, EVERY = "1 hour", "1 hour"
_TABLES = {
    "counts": "period timestamp, period_end timestamp, n bigint, errors bigint, batch bigint",
    "late": "source string, hour timestamp, n bigint, batch bigint",
    "seen": "latest timestamp, batch bigint",
}


def _stored(spark: SparkSession, path: str, table: str) -> DataFrame:
    if not path_exists(spark, f"{path}/{table}"):
        return spark.createDataFrame([], _TABLES[table])
    return spark.read.schema(_TABLES[table]).parquet(f"{path}/{table}")


def watermark(spark: SparkSession, path: str, delay: str = DELAY, before: int | None = None):
    """The time up to which periods are closed, for the micro-batch ``before`` or the next one; None at first."""
    seen = _stored(spark, path, "seen")
    seen = seen if before is None else seen.filter(F.col("batch") < before)
    return seen.agg((F.max("latest") - F.expr(f"INTERVAL {delay}")).alias("w")).first()["w"]


def count_batch(path: str, delay: str = DELAY, every: str = EVERY, source: str = "source_file"):
    """Writer of one micro-batch of rows with ``timestamp``, ``severity`` and a source."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        closed = watermark(spark, path, delay, batch_id)
        rows = batch.select(
            "timestamp", (F.col("severity") == ERROR).cast("long").alias("bad"), F.col(source).cast("string").alias("source"),
            F.window("timestamp", every).alias("w"),
        )
        # window() leaves out rows without a time, so these are read apart.
        timeless = batch.filter("timestamp IS NULL").select(F.col(source).cast("string").alias("source"))
        behind = F.lit(False) if closed is None else F.col("w.end") <= F.lit(closed)
        kept = rows.withColumn("behind", behind).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            late = kept.filter("behind").select("source", F.date_trunc("hour", "timestamp").alias("hour")).unionByName(
                timeless.withColumn("hour", F.lit(None).cast("timestamp")))
            found = {
                "counts": kept.filter("NOT behind").groupBy(F.col("w.start").alias("period"), F.col("w.end").alias("period_end")).agg(
                    F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("errors")),
                "late": late.groupBy("source", "hour").agg(F.count("*").alias("n")),
                # Last: a batch without this has not ended.
                "seen": kept.agg(F.max("timestamp").alias("latest")),
            }
            for table, df in found.items():
                df.write.mode("overwrite").parquet(f"{path}/{table}/batch={batch_id}")
        finally:
            kept.unpersist()

    return write


def start_counting(rows: DataFrame, path: str, checkpoint: str, delay: str = DELAY, every: str = EVERY,
                   source: str = "source_file", trigger: str | None = None):
    """Start counting a stream; without ``trigger`` it stops when the input is used up."""
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(count_batch(path, delay, every, source))
    return writer.trigger(**({"availableNow": True} if trigger is None else {"processingTime": trigger})).start()


def period_counts(spark: SparkSession, path: str, delay: str = DELAY) -> DataFrame:
    """``period, n, errors, rate, closed``; a period that is not closed may still grow."""
    end = watermark(spark, path, delay)
    total = _stored(spark, path, "counts").groupBy("period", "period_end").agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"))
    closed = F.lit(False) if end is None else F.col("period_end") <= F.lit(end)
    return total.select("period", "n", "errors", F.round(F.col("errors") / F.col("n"), 6).alias("rate"), closed.alias("closed"))


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """``source, hour, n``: rows that came when their period was closed."""
    return _stored(spark, path, "late").groupBy("source", "hour").agg(F.sum("n").alias("n"))


def compact_counts(spark: SparkSession, path: str) -> None:
    """Bring all micro-batches but the newest, which may be repeated, into one folder of each table."""
    done = sorted(r[0] for r in _stored(spark, path, "seen").select("batch").distinct().collect())[:-1]
    if len(done) < 2:
        return
    merge = {
        "counts": (["period", "period_end"], ["n", "errors"], F.sum), "late": (["source", "hour"], ["n"], F.sum), "seen": ([], ["latest"], F.max),
    }
    for table, (keys, values, agg) in merge.items():
        old = _stored(spark, path, table).filter(F.col("batch") <= done[-1])
        whole = materialise(old.groupBy(*keys).agg(*[agg(v).alias(v) for v in values]), table)
        # The folder that stays is written last but one: until the others go, readers must not see both.
        for b in done[:-1]:
            remove_folder(spark, f"{path}/{table}/batch={b}")
        whole.write.mode("overwrite").parquet(f"{path}/{table}/batch={done[-1]}")
