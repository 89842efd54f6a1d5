"""Forgetting subjects in every store, opening only the folders that may hold them.

Each folder of a store (a load and day of logs, a batch of documents) gets a Bloom filter of the tokens in it: words
of all its text columns, of JSON and maps too, and parts of words around ``=:,;"/`` and brackets. A
filter is one or more bitmaps of 32,768 bits, so it grows with the number of different tokens and its
error stays below one in a thousand. A subject is a token, such as a host, an account or an address. Folders whose filters do not hold it
are neither read nor written; the others are read, rows that hold a subject as a token go, and only folders that lose rows
are written again. The rows to keep are written to the shared folder first.

Filters are made by folder and kept beside the store; a folder without one counts as one that may hold anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cedarlog.operators.joins import broadcast_if_small
from cedarlog.session import materialise, scratch_scope
from cedarlog.sources.lines import path_exists, remove_folder

#: Bits of one bitmap (that of Spark's bitmap functions), tokens that share one, and bits set for a token.
BITS, TOKENS, HASHES = 32_768, 2_000, 7
BREAK = r"""[\s=:,;"'/\\\[\](){}<>|]+"""


def _text_of(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    return c if isinstance(field.dataType, T.StringType) else F.to_json(F.struct(c)) if isinstance(
        field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) else c.cast("string")


def tokens(schema: T.StructType, leave: tuple[str, ...] = ()) -> Column:
    """Distinct lower-cased words of all columns, and their parts."""
    fields = [f for f in schema.fields if f.name not in leave and not isinstance(f.dataType, (T.BinaryType, T.DateType, T.TimestampType))
              and not (isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.FloatType, T.DoubleType)))]
    text = F.lower(F.concat_ws(" ", *[_text_of(f) for f in fields]))
    return F.array_distinct(F.array_remove(F.concat(F.split(text, r"\s+"), F.split(text, BREAK)), ""))


def _places(token: Column, blocks: Column) -> tuple[Column, Column]:
    """The bitmap of a token and its bits there."""
    block = F.pmod(F.xxhash64(F.lit(0), token), blocks).cast("int")
    return block, F.transform(F.sequence(F.lit(1), F.lit(HASHES)), lambda i: F.pmod(F.xxhash64(i, token), F.lit(BITS)))


def build_filters(rows: DataFrame, folder: list[str]) -> DataFrame:
    """``folder columns, blocks, block, bits``: the filters of the folders that ``rows`` lie in."""
    each = rows.select(*folder, F.explode(tokens(rows.schema, tuple(folder))).alias("t")).distinct()
    each = materialise(each, "tokens")
    sizes = each.groupBy(*folder).agg(F.greatest(F.ceil(F.count("*") / TOKENS), F.lit(1)).alias("blocks"))
    placed = each.join(broadcast_if_small(sizes), folder)
    block, places = _places(F.col("t"), F.col("blocks"))
    bits = placed.select(*folder, "blocks", block.alias("block"), F.explode(places).alias("p"))
    return bits.groupBy(*folder, "blocks", "block").agg(F.bitmap_construct_agg(F.col("p")).alias("bits"))


def update_filters(spark: SparkSession, store: str, filters: str, folder: list[str]) -> int:
    """Make the filters of folders that have none; the number of such folders."""
    have = spark.read.parquet(store).select(*folder).distinct()
    known = spark.read.parquet(filters).select(*folder).distinct() if path_exists(spark, filters) else have.limit(0)
    new = materialise(have.join(known, folder, "left_anti"), "new-folders")
    n = new.count()
    if n:
        rows = spark.read.parquet(store).join(F.broadcast(new), folder, "left_semi")  # a row for each folder
        build_filters(rows, folder).write.mode("append").parquet(filters)
    return n


def _holds(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (place % 8).cast("int"))) != 0


def candidates(spark: SparkSession, store: str, filters: str, subjects: DataFrame, folder: list[str]) -> DataFrame:
    """The folders that may hold one of ``subjects`` (column ``token``)."""
    have = spark.read.parquet(store).select(*folder).distinct()
    if not path_exists(spark, filters):
        return have
    held = spark.read.parquet(filters)
    asked = subjects.select(F.lower("token").alias("token")).filter("token <> ''").distinct()
    per_size = held.select("blocks").distinct().join(broadcast_if_small(asked))  # few sizes, few subjects
    block, places = _places(F.col("token"), F.col("blocks"))
    wanted = per_size.select("blocks", block.alias("block"), places.alias("places"))
    hit = held.join(broadcast_if_small(wanted), ["blocks", "block"]).filter(
        F.forall("places", lambda p: _holds(F.col("bits"), p))).select(*folder).distinct()
    unknown = have.join(held.select(*folder).distinct(), folder, "left_anti")
    return have.join(hit.unionByName(unknown).distinct(), folder, "left_semi")


def forget(spark: SparkSession, store: str, filters: str, subjects: DataFrame, folder: list[str]) -> int:
    """Remove the rows of a store that hold one of ``subjects`` (column ``token``); the number of folders written.

    A subject is found as a whole word or part of one, in any column and any case.
    """
    with scratch_scope(spark):
        opened = materialise(candidates(spark, store, filters, subjects, folder), "candidates")
        names = [tuple(r) for r in opened.collect()]  # a row for each folder to open
        if not names:
            return 0
        rows = spark.read.parquet(store)
        here = F.struct(*folder).isin([F.struct(*[F.lit(v).alias(c) for c, v in zip(folder, n, strict=True)]) for n in names])
        asked = subjects.select(F.lower("token").alias("token")).filter("token <> ''").distinct()
        found = materialise(rows.filter(here).withColumn("_row", F.monotonically_increasing_id()), "opened")
        words = found.select("_row", F.explode(tokens(rows.schema, tuple(folder))).alias("token"))
        gone = words.join(broadcast_if_small(asked), "token", "left_semi").select("_row").distinct().withColumn("_gone", F.lit(True))
        marked = found.join(gone, "_row", "left").drop("_row").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
        marked = materialise(marked, "marked")
        hit = {tuple(r) for r in marked.filter("_gone").select(*folder).distinct().collect()}
        if not hit:
            return 0
        there = F.struct(*folder).isin([F.struct(*[F.lit(v).alias(c) for c, v in zip(folder, n, strict=True)]) for n in sorted(hit)])
        kept = marked.filter(there & ~F.col("_gone")).drop("_gone")
        (
            kept.hint("rebalance", *folder).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folder).parquet(store)
        )
        left = {tuple(r) for r in kept.select(*folder).distinct().collect()}
        for n in hit - left:
            remove_folder(spark, store + "".join(f"/{c}={v}" for c, v in zip(folder, n, strict=True)))
        if path_exists(spark, filters):
            # The filters of folders that changed are made anew; others stay as they are.
            old = spark.read.parquet(filters)
            gone = F.struct(*folder).isin([F.struct(*[F.lit(v).alias(c) for c, v in zip(folder, n, strict=True)]) for n in sorted(hit)])
            rest = old.filter(~gone)
            if left:
                fresh = spark.read.parquet(store).filter(there)
                rest = rest.unionByName(build_filters(fresh, folder))
            materialise(rest, "filters").write.mode("overwrite").parquet(filters)
        return len(hit)
