"""Which services fail after each other: frequent ordered episodes over traces.

A trace is the sequence of its failing services by time. An episode is a sequence of services that stands in
a trace in this order, not necessarily side by side; its support is the number of distinct traces that hold it.
Spark's PrefixSpan grows episodes by projection on their prefix. Before that, a run of the same service in a
trace is cut to the longest episode asked for, which changes no support and keeps a noisy trace short, and equal
sequences of different traces stay apart, as each counts.

Failures of one trace in the same instant are ordered by service. Rows without trace, service or time are left out.
"""

from __future__ import annotations

from pyspark.ml.fpm import PrefixSpan
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cedarlog.operators.queries import ERROR

LONGEST = 4
#: Items of projected prefixes that one task takes over.
LOCAL_ITEMS = 32_000_000


def sequences(logs: DataFrame, trace: str = "trace_id", item: str = "service_name", longest: int = LONGEST) -> DataFrame:
    """``trace, sequence``: the failing items of each trace in order, runs cut to ``longest``."""
    rows = logs.filter((F.col("severity") == ERROR) & F.col(trace).isNotNull() & F.col(item).isNotNull() & F.col("timestamp").isNotNull())
    order = Window.partitionBy(trace).orderBy("timestamp", item)
    # The row is dropped if the ``longest`` rows before it are of the same item.
    before = [F.lag(item, k).over(order) == F.col(item) for k in range(1, longest + 1)]
    alike = before[0]
    for b in before[1:]:
        alike = alike & b
    kept = rows.select(trace, "timestamp", item).withColumn("_alike", F.coalesce(alike, F.lit(False))).filter("NOT _alike")
    listed = F.sort_array(F.collect_list(F.struct("timestamp", item)))
    return kept.groupBy(trace).agg(F.transform(listed, lambda x: F.array(x[item])).alias("sequence"))


def frequent_episodes(logs: DataFrame, least: int, longest: int = LONGEST, trace: str = "trace_id", item: str = "service_name") -> DataFrame:
    """``episode, length, support`` of all episodes that at least ``least`` traces hold."""
    found = sequences(logs, trace, item, longest).persist()
    try:
        n = found.count()
        shape = f"episode array<{logs.schema[item].dataType.simpleString()}>, length int, support bigint"
        if n == 0 or n < least:
            return logs.sparkSession.createDataFrame([], shape)
        # A share that rounds up to exactly ``least`` traces.
        spans = PrefixSpan(minSupport=max(least - 0.5, 0.5) / n, maxPatternLength=longest, maxLocalProjDBSize=LOCAL_ITEMS)
        patterns = spans.findFrequentSequentialPatterns(found)
        # One item a step: steps with several cannot occur.
        return patterns.select(F.flatten("sequence").alias("episode"), F.size("sequence").alias("length"), F.col("freq").alias("support"))
    finally:
        found.unpersist()
