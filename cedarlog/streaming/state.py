"""What the stateful streams share: the store, and time that only moves forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: Spark's state store on RocksDB, which keeps state on disk and writes changes only.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ARRIVED = "arrived"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers needs this store; it is a session setting that starting queries read."""
    spark.conf.set(PROVIDER, ROCKSDB)


def with_arrival(rows: DataFrame, idle: str) -> DataFrame:
    """Add the time of the micro-batch, with a watermark ``idle`` behind it.

    A row is never late by this clock, so nothing is dropped, whatever the times in the rows say, and a
    timer set to the arrival of a key's last row fires when the stream has gone on for ``idle`` without one.
    A batch that is repeated after a failure has the time it had at first.
    """
    return rows.withColumn(ARRIVED, F.current_timestamp()).withWatermark(ARRIVED, idle)


def millis(moment) -> int:
    return round(moment.timestamp() * 1000)


def stored_state(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """``key, value`` of a state variable as of the last finished micro-batch."""
    use_rocksdb(spark)
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint).select("key", "value")
