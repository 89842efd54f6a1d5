"""Log files that grow and rotate are read once, from where the last load stopped.

A rotated file keeps its content under a new name, and may be compressed, so a file is known by what it
holds: its first line, and the lines that were consumed from it. The ledger has one row per file ever
read: hash of the first line, number of consumed lines, hash of the last of them, and a hash of all of them with
their numbers. A file goes on a ledger row if all four agree with its own beginning; of several rows the
longest counts. So ``x.log`` is found again as ``x.log.1`` and as ``x.log.2.gz``, whatever it is called and
however it grew, and a new ``x.log`` is a new file even if it begins with the same banner.

A plain file whose size says that its last line has no line end is still being written: that line
waits for the next load. Of two files of one load with the same lines the first by name counts, and one that is the
beginning of another gives nothing (a copy made while the original went on). Empty files are not recorded.
Numbering and hashing run by file block; only sums meet by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cedarlog.operators.joins import broadcast_if_small
from cedarlog.session import materialise
from cedarlog.sources.lines import ROTATED_LOGS, path_exists

LEDGER = "first bigint, consumed bigint, last bigint, content decimal(38,0)"
_EMPTY = "value string, source_file string, nth bigint"


def numbered(lines: DataFrame) -> DataFrame:
    """Add ``nth`` (from 1) to lines with ``source_file, block, line_id``; no task sees more than a block of a file."""
    in_block = Window.partitionBy("source_file", "block").orderBy("line_id")
    local = materialise(lines.withColumn("n", F.row_number().over(in_block)), "numbered")
    before = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = local.groupBy("source_file", "block").agg(F.max("n").alias("lines")).select(
        "source_file", "block", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("offset")
    )
    return local.join(offsets, ["source_file", "block"]).withColumn("nth", F.col("offset") + F.col("n")).drop("n", "offset", "block", "line_id")


def _line_hash() -> Column:
    return F.xxhash64(F.lit(7), "value")


def _content(*when: Column) -> Column:
    """Hash of lines with their numbers that can be added up in any order."""
    each = F.xxhash64("nth", "value").cast("decimal(38,0)")
    return F.sum(F.when(when[0], each) if when else each)


def _complete(lines: DataFrame) -> DataFrame:
    """Without a last line that has no line end yet; compressed and rotated files are never written again."""
    per_file = lines.groupBy("source_file").agg(
        F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("nth").alias("lines"), F.first("size").alias("size")
    )
    open_end = F.col("source_file").endswith(".log") & (F.col("bytes") - 1 == F.col("size"))
    cut = broadcast_if_small(per_file.filter(open_end).select("source_file", F.col("lines").alias("nth")))
    return lines.join(cut, ["source_file", "nth"], "left_anti")


def _files(lines: DataFrame) -> DataFrame:
    """A ledger row for each file of ``lines``."""
    return lines.groupBy("source_file").agg(
        F.max(F.when(F.col("nth") == 1, F.col("h"))).alias("first"), F.max("nth").alias("consumed"),
        F.max_by("h", "nth").alias("last"), _content().alias("content"),
    )


def _matches(lines: DataFrame, files: DataFrame, known: DataFrame, *more: str) -> DataFrame:
    """``source_file`` with the rows of ``known`` that its lines begin with."""
    heads = files.select("source_file", F.col("first").alias("own_first"))
    rows = known.withColumnRenamed("last", "known_last").withColumnRenamed("content", "known_content")
    # Rows with the same first line (a banner) are told apart by the line where they stopped.
    tried = lines.select("source_file", "nth", "h").join(broadcast_if_small(heads), "source_file").join(
        broadcast_if_small(rows), (F.col("own_first") == F.col("first")) & (F.col("nth") == F.col("consumed")) & (F.col("h") == F.col("known_last"))
    ).select("source_file", "consumed", "known_content", *more)
    seen = lines.join(broadcast_if_small(tried), "source_file").groupBy("source_file", "consumed", "known_content", *more).agg(
        _content(F.col("nth") <= F.col("consumed")).alias("own")
    )
    return seen.filter(F.col("own") == F.col("known_content"))


def read_new_lines(spark: SparkSession, folder: str, ledger: DataFrame | None, glob: str = ROTATED_LOGS) -> tuple[DataFrame, DataFrame]:
    """Lines that no earlier load consumed (``value, source_file, nth``), and the ledger after this load.

    ``nth`` is the number of the line in its file. A missing or empty folder gives no lines and the ledger as it was.
    """
    ledger = spark.createDataFrame([], LEDGER) if ledger is None else ledger
    if not path_exists(spark, folder):
        return spark.createDataFrame([], _EMPTY), ledger
    raw = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "false").text(folder).select(
        "value", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_id"),
    )
    lines = _complete(materialise(numbered(raw), "lines")).withColumn("h", _line_hash())
    files = materialise(_files(lines), "files")

    # A file that another one of this load begins with is a copy of it.
    other = files.select("first", "consumed", "last", "content", F.col("source_file").alias("short"))
    inside = _matches(lines, files, other, "short").filter(F.col("source_file") != F.col("short"))
    sizes = files.select("source_file", F.col("consumed").alias("all"))
    copies = inside.join(sizes, "source_file").filter(
        (F.col("all") > F.col("consumed")) | (F.col("source_file") < F.col("short"))
    ).select(F.col("short").alias("source_file")).distinct()
    kept = materialise(files.join(copies, "source_file", "left_anti"), "kept")

    done = _matches(lines, kept, ledger).groupBy("source_file").agg(F.max("consumed").alias("done"))
    state = materialise(kept.join(done, "source_file", "left").withColumn("done", F.coalesce("done", F.lit(0))), "state")
    new = lines.join(broadcast_if_small(state.select("source_file", "done")), "source_file").filter(F.col("nth") > F.col("done"))
    # Rows that a longer reading of the same file takes the place of.
    names = ["first", "consumed", "last", "content"]
    grown = _matches(lines, kept, ledger).join(state.select("source_file", "first"), "source_file").select(
        "first", "consumed", F.col("known_content").alias("content"))
    after = ledger.join(grown, ["first", "consumed", "content"], "left_anti").select(names).unionByName(state.select(names)).distinct()
    return new.select("value", "source_file", "nth"), after


def load_ledger(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    """The newest ledger and its version, or None and -1 before the first load."""
    if not path_exists(spark, path):
        return None, -1
    stored = spark.read.schema(f"{LEDGER}, version int").parquet(path)
    newest = stored.agg(F.max("version")).first()[0]
    return (None, -1) if newest is None else (stored.filter(F.col("version") == newest).drop("version"), newest)


def save_ledger(ledger: DataFrame, path: str, version: int) -> None:
    """Write one version as a whole; a load that stops before this is simply repeated under its number."""
    materialise(ledger, "ledger").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")
