"""Small text helpers shared by the other modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Trim every kind of white space at both ends (``trim`` alone takes only blanks).

    Most texts need no trimming, which a look at their two end characters tells.
    """
    ends = F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(1)))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(c, r"(?U)^\s+|\s+$", "")).otherwise(c)


def collapse_space(c: Column) -> Column:
    """Each run of white space as one blank; most texts already are that way."""
    return F.when(
        c.rlike(r"(?U)\s(?:(?<! )|\s)"), F.regexp_replace(c, r"(?U)\s+", " ")
    ).otherwise(c)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a name so that ``body`` may use it often but it is computed once."""
    return F.transform(F.array(value), body)[0]


def tokens(c: Column) -> Column:
    """White-space separated words, empty ones dropped."""
    return F.filter(F.split(collapse_space(c), " "), lambda t: t != "")


def cut(c: Column, n: int, mark: str = "...") -> Column:
    """The text cut to ``n`` characters with a mark when something was cut."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(mark))).otherwise(c)


def compute(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns that are computed exactly once for each row.

    A plain projection may be inlined into every later expression and filter that uses it, so
    a filter on one parsed field would parse the line again. Predicates do not move below a
    generator, and a one-element array generates one row.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))
