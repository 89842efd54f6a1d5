"""Keys, order and sizes that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cedarlog.session import materialise

__all__ = ["KEY", "SPACE", "MARKS", "doc_key", "lower_ascii", "materialise", "fresh", "read", "words_between"]

#: What tells a document from all others: its id, and the hash of its text should ids repeat.
KEY = ("_id", "_text_hash")

#: What stands between words, as the inside of a class: white space, or all ASCII but letters and digits (A-Z counts as one of them).
SPACE = r"\x20\x09-\x0D"
MARKS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"


def words_between(text: Column, marks: str) -> Column:
    """The words of a text, given what stands between them.

    A plain class is looked for many times faster than a negated one (measured: 1 s against 22 s for 0.17 GB).
    """
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{marks}]+", -1), "")


def doc_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Columns of ``KEY``. Rows that agree in id and text are one document given twice."""
    return [
        F.col(id_col).alias(KEY[0]),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias(KEY[1]),
    ]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores in front as make it new in ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
