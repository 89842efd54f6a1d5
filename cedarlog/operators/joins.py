"""Joins of a big table with a smaller one whose size is not known beforehand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after a row count; else leave the choice to adaptive execution."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def join_by_weight(
    big: DataFrame, small: DataFrame, keys: list[str], weight: str, share: int = 1000
) -> DataFrame:
    """Left join for skewed keys, given how many ``big`` rows each key of ``small`` has.

    At most ``share`` keys can hold more than one ``share``-th of all rows, so those are
    broadcast and their rows are not shuffled. The other keys are all light and join by shuffle.
    """
    total = small.agg(F.sum(weight)).first()[0] or 0
    hot = small.filter(F.col(weight) * share > F.lit(total)).drop(weight)
    cold = small.filter(F.col(weight) * share <= F.lit(total)).drop(weight)
    mark = "_hot"
    tagged = big.join(F.broadcast(hot.withColumn(mark, F.lit(True))), keys, "left")
    extra = [c for c in hot.columns if c not in keys]
    done = tagged.filter(F.col(mark)).drop(mark)
    rest = tagged.filter(F.col(mark).isNull()).drop(mark, *extra)
    return done.unionByName(rest.join(cold, keys, "left"))

