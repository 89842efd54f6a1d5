"""Line deduplication by a suffix array over line numbers, with DataFrame operations only.

Every document is a sequence of lines. Lines that occur once cannot be in a repeated run, the others
are ranked. Suffixes are then ranked by more and more lines: the pair of the ranks at a line and some lines
further on is sorted by range partitioning, and its place in that order is the new rank. Up to
``min_lines`` one line is added a round, from there on the depth doubles. Positions whose pair is unique
leave, so each round sees fewer rows, and doubling ends when no group is left: the order of suffixes
is then complete. Equal ranks at a depth are an interval of suffixes whose longest common prefix has at least that
many lines. The earliest member of an interval is the first copy, the others are later copies; overlapping ones
of all depths join to maximal repeated runs.

A run counts from ``min_lines`` lines, or if it has ``min_chars`` characters in fewer lines: one long line, or a
short line next to it that is repeated with it. Earlier means a smaller id (null first), then text hash, then
position. Only later copies go. Lines are compared by two independent 64-bit hashes.

Lines end at a line feed. Null and empty texts have no line and are kept as they are. Rows that agree in id
and text are one document given twice: each gets the same result. An empty table gives an empty table.
Other columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cedarlog.llm.common import doc_key, materialise
from cedarlog.operators.joins import join_by_weight

MIN_LINES = 3
MIN_CHARS = 60
_KEY = ["_id", "_text_hash"]


def _lines(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def _rank(groups: DataFrame, by: list[str], name: str) -> DataFrame:
    """``groups`` numbered in the order of ``by``; the numbers have gaps but keep the order."""
    ordered = groups.repartitionByRange(*by).sortWithinPartitions(*by)
    return materialise(ordered.withColumn("rank", F.monotonically_increasing_id()), name)


def _intervals(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """``rows`` that share ``by`` with others, with the rank of their group and its first position."""
    groups = (
        rows.groupBy(*by)
        .agg(F.count("*").alias("n"), F.min(F.struct(*_KEY, "pos")).alias("first"))
        .filter("n > 1")
    )
    ranked = _rank(groups, by, f"{name}-ranks")
    # The few groups that hold a large share of all rows, such as blank lines, are broadcast.
    joined = join_by_weight(rows.drop("rank", "first"), ranked, by, "n").filter("rank IS NOT NULL")
    return materialise(joined.drop(*by), name)


def _later(rows: DataFrame, size: int) -> DataFrame:
    return rows.filter(F.struct(*_KEY, "pos") > F.col("first")).select(*_KEY, "pos", F.lit(size).alias("size"))


def repeated_runs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``_id, _text_hash, runs``: for each document with later copies the maximal runs of their lines,
    ``array<struct<start, end>>`` in order, lines from 0, ``end`` excluded."""
    # Repeated rows have equal positions, and a position is not later than itself.
    split = documents.select(*doc_key(id_col, text_col), _lines(F.col(text_col)).alias("lines"))
    lines = split.select(*_KEY, F.posexplode("lines").alias("pos", "line")).select(
        *_KEY, "pos", F.xxhash64(F.lit(1), "line").alias("h1"), F.xxhash64(F.lit(2), "line").alias("h2"),
        F.length("line").cast("long").alias("chars"),
    )
    rows = _intervals(materialise(lines.withColumn("total", F.col("chars")), "lines"), ["h1", "h2"], "suffixes-1")
    depth, found = 1, _later(rows if min_lines <= 1 else rows.filter(F.col("total") >= min_chars), 1)
    while True:
        step = 1 if depth < min_lines else depth
        further = Window.partitionBy(*_KEY).orderBy("pos").rangeBetween(step, step)
        pairs = rows.withColumnRenamed("rank", "own").withColumns({
            "next": F.max("own").over(further),
            # Of the window that is one line longer; beyond ``min_lines`` nobody asks.
            "total": F.col("chars") + F.max("total").over(further),
        }).filter(F.col("next").isNotNull())
        depth += step
        rows = _intervals(pairs, ["own", "next"], f"suffixes-{depth}")
        if rows.isEmpty():
            break
        found = found.union(_later(rows if depth >= min_lines else rows.filter(F.col("total") >= min_chars), depth))

    # Overlapping and adjacent copies join: a run begins where all earlier copies have ended.
    before = Window.partitionBy(*_KEY).orderBy("pos", "size").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*_KEY).orderBy("pos", "size").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("pos") + F.col("size")
    return (
        found.withColumn("new", (F.coalesce(F.max(end).over(before), F.lit(-1)) < F.col("pos")).cast("int"))
        .withColumn("run", F.sum("new").over(so_far))
        .groupBy(*_KEY, "run")
        .agg(F.min("pos").alias("start"), F.max(end).alias("end"))
        .groupBy(*_KEY)
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))
    )


def dedup_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``row, n_lines, n_removed, kept_text``: each input row as a struct, its lines, the number
    that later copies hold, and the text without those."""
    runs = repeated_runs(documents, id_col, text_col, min_lines, min_chars)
    rows = documents.select(*doc_key(id_col, text_col), F.struct("*").alias("row"))
    joined = rows.join(
        runs.select(F.col("_id").alias("_run_id"), F.col("_text_hash").alias("_run_hash"), "runs"),
        F.col("_id").eqNullSafe(F.col("_run_id")) & (F.col("_text_hash") == F.col("_run_hash")),
        "left",
    ).select("row", "runs", _lines(F.col("row")[text_col]).alias("lines"))
    size, text = F.size("lines"), F.col("row")[text_col]
    stops = F.concat(F.transform("runs", lambda r: r["start"]), F.array(size))
    kept = F.transform(
        stops,
        lambda stop, i: F.slice(
            "lines",
            F.when(i == 0, 0).otherwise(F.get(F.col("runs"), i - 1)["end"]) + 1,
            stop - F.when(i == 0, 0).otherwise(F.get(F.col("runs"), i - 1)["end"]),
        ),
    )
    removed = F.aggregate("runs", F.lit(0), lambda a, r: a + r["end"] - r["start"])
    return joined.select(
        "row",
        size.cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("runs").isNull(), text).otherwise(F.array_join(F.flatten(kept), "\n")).alias("kept_text"),
    )


def clean(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars",
          min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents without later copies of lines, in their own columns; ``length_col`` follows the text.

    A document of which nothing but later copies was there is gone.
    """
    out = dedup_lines(documents, id_col, text_col, min_lines, min_chars).filter(
        (F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))
    )
    changed = F.col("n_removed") > 0

    def column(name: str) -> Column:
        own = F.col("row")[name]
        if name == text_col:
            return F.col("kept_text").alias(name)
        if name == length_col:
            kind = documents.schema[name].dataType
            return F.when(changed, F.length("kept_text").cast(kind)).otherwise(own).alias(name)
        return own.alias(name)

    return out.select(*[column(c) for c in documents.columns])
