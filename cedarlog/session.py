"""Session settings the library relies on, and the shared folder for cut lineage."""

from __future__ import annotations

import contextlib
import re
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

UTC = "UTC"


def build_session(app: str = "cedarlog", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution and skew handling on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": UTC,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.variant.allowDuplicateKeys": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def require_utc(spark: SparkSession) -> None:
    """Zone-less log times mean UTC, so any other session zone would shift them."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in (UTC, "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone must be UTC, it is {zone}")


def allow_repeated_keys(spark: SparkSession) -> None:
    """A JSON object may name a key twice; the last one counts. A setting that running queries read."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, else what the session already uses.

    Only a local session may fall back to a folder of this machine.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cedarlog-"))
    return sc.getCheckpointDir().rstrip("/")


_made = threading.local()


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if getattr(_made, "open", None):
        _made.open[-1].append(path)
    return path


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """For whole jobs: removes the intermediate tables made inside, also when the job fails.

    What a job returns as a lazy DataFrame may still read its tables, so only jobs that write their
    result use it.
    """
    if not hasattr(_made, "open"):
        _made.open = []
    _made.open.append([])
    try:
        yield
    finally:
        for path in _made.open.pop():
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result survives lost executors, has no lineage, and its file sizes give the planner
    real statistics for later joins.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark removes the shuffle files of a query when it ends; else they stay until the driver collects garbage.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise_lean(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """:func:`materialise` for tables about as big as the input, of what ``make`` gives.

    Of the way there nothing stays on disk: neither the tables that ``make`` wrote nor the shuffle files of this query.
    """
    path = scratch_path(spark, name)
    with scratch_scope(spark):
        df, before = make(), spark.conf.get(REMOVE_SHUFFLES, None)
        spark.conf.set(REMOVE_SHUFFLES, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            spark.conf.unset(REMOVE_SHUFFLES) if before is None else spark.conf.set(REMOVE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
