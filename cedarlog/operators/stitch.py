"""Multi-line records: continuation lines join the head line before them.

A running count over a whole file would need the file in one task. Here lines are numbered
inside their block (a file split), one row per block carries totals forward, and both meet
again on the same partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cedarlog.functions.parse import ACCESS, STANDARD, SYSLOG

#: Lines of one record that one task joins.
PART_LINES = 10_000


def is_head(line: Column) -> Column:
    """A line that starts a record in one of the known layouts."""
    return (
        line.startswith("{")
        | line.rlike("(?sU)^" + STANDARD)
        | line.rlike("(?sU)^" + SYSLOG)
        | line.rlike("(?sU)^" + ACCESS)
    )


def stitch(
    lines: DataFrame,
    head: Column,
    file: str = "source_file",
    block: str = "block",
    line_id: str = "line_id",
    value: str = "value",
    part_lines: int = PART_LINES,
) -> DataFrame:
    """``file, record, value, n_lines``: lines of a record joined by line breaks.

    Lines before the first head form record 0. A long record is first joined in parts of ``part_lines``
    lines on different tasks, so that only its parts meet in the row that holds it.
    """
    in_block = Window.partitionBy(file, block).orderBy(line_id)
    so_far = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = (
        lines.select(file, block, line_id, value, head.cast("long").alias("_head"))
        .withColumn("_n", F.row_number().over(in_block))
        .withColumn("_heads", F.sum("_head").over(so_far))
        .withColumn("_last", F.max(F.when(F.col("_head") == 1, F.col("_n"))).over(so_far))
    )
    before = Window.partitionBy(file).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        local.groupBy(file, block)
        .agg(
            F.count("*").alias("_lines"),
            F.sum("_head").alias("_block_heads"),
            F.max("_last").alias("_block_last"),
        )
        .withColumn("_line_offset", F.coalesce(F.sum("_lines").over(before), F.lit(0)))
        .withColumn("_head_offset", F.coalesce(F.sum("_block_heads").over(before), F.lit(0)))
        .withColumn(
            "_head_before",
            F.coalesce(F.max(F.col("_line_offset") + F.col("_block_last")).over(before), F.lit(1)),
        )
        .select(file, block, "_line_offset", "_head_offset", "_head_before")
    )
    numbered = local.join(totals, [file, block]).select(
        file,
        (F.col("_head_offset") + F.col("_heads")).alias("record"),
        (F.col("_line_offset") + F.col("_n")).alias("_at"),
        F.coalesce(F.col("_line_offset") + F.col("_last"), F.col("_head_before")).alias("_start"),
        value,
    )
    parts = (
        numbered.withColumn(
            "part", F.floor((F.col("_at") - F.col("_start")) / F.lit(part_lines)).cast("long")
        )
        .groupBy(file, "record", "part")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("_at", value))), lambda x: x[value]
                ),
                "\n",
            ).alias(value),
            F.count("*").alias("n_lines"),
        )
    )
    return parts.groupBy(file, "record").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("part", value))), lambda x: x[value]), "\n"
        ).alias(value),
        F.sum("n_lines").alias("n_lines"),
    )
