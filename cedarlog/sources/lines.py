"""Raw line sources, as a batch or as a stream, from plain or compressed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CURRENT_LOGS = "*.log"
ROTATED_LOGS = "*.log*"  # also x.log.1 and x.log.2.gz
#: Stored bytes of one task of :func:`spread`.
SPLIT = 2_000_000
#: From here on a size only says that the planner knows none.
UNKNOWN = 1 << 60


def _folder(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, folder = _folder(spark, path)
    return fs.exists(folder)


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, folder = _folder(spark, path)
    fs.delete(folder, True)


def _no_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "value string, source_file string")


def read_lines(
    spark: SparkSession, folder: str, glob: str = CURRENT_LOGS, positions: bool = False
) -> DataFrame:
    """``value, source_file`` of the files of one folder, not of its subfolders.

    A missing or empty folder gives no rows. ``positions`` adds ``block`` and ``line_id``,
    which order the lines of a file without reading it in one task.
    """
    if not path_exists(spark, folder):
        return _no_lines(spark)
    reader = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "false")
    columns = [F.col("value"), F.col("_metadata.file_name").alias("source_file")]
    if positions:
        columns += [
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line_id"),
        ]
    return reader.text(folder).select(*columns)


def spread(rows: DataFrame) -> DataFrame:
    """Even out rows when the scan has fewer tasks than the cluster has cores, or tasks of more than ``SPLIT`` bytes.

    That is so for a few gzip files or single row groups, which cannot be split. The number of tasks grows with the
    size of the tables read, so a task stays as long as it is however much there is. Inputs with
    enough splits pass unchanged, without a shuffle.
    """
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    cores = rows.sparkSession.sparkContext.defaultParallelism
    wanted = max(cores, -(-sum(s for s in sizes if s < UNKNOWN) // SPLIT))
    return rows.repartition(wanted) if rows.rdd.getNumPartitions() < wanted else rows


def stream_lines(
    spark: SparkSession, folder: str, glob: str = CURRENT_LOGS, files_per_batch: int = 1000
) -> DataFrame:
    """The same two columns as :func:`read_lines`, from files as they arrive."""
    return (
        spark.readStream.schema(T.StructType([T.StructField("value", T.StringType())]))
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .text(folder)
        .select("value", F.col("_metadata.file_name").alias("source_file"))
    )


def stream_topic(
    spark: SparkSession,
    servers: str,
    topic: str,
    offsets_per_batch: int = 10_000_000,
    start: str | None = None,
) -> DataFrame:
    """The same two columns from a Kafka topic; ``start`` is a time to begin after."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", offsets_per_batch)
    )
    if start is not None:
        reader = reader.option("startingTimestamp", start)
    return reader.load().select(
        F.col("value").cast("string").alias("value"), F.col("topic").alias("source_file")
    )
