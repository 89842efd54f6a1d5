"""Mixing sources to target weights by hash-threshold histograms.

Sources share a budget by weight; a target stops at ``max_repeats`` times its source's size and the excess
is shared anew among the rest until none is above. A document is taken as often as its source's target
holds the source's size, and once more if its hash lies below the source's threshold. Thresholds come
from histograms: words are summed by source and hash bucket, whole buckets are taken while they fit,
and only the bucket in which the budget ends is split by further hash bits, level within level, until one
document is left there. It is taken if that brings the source nearer to its target. No rows are sorted.

The hash depends on the document's id and text alone, so reruns agree and a larger budget takes a superset.
Only rows that agree in both are taken together. Size is the number of words
without white space; null and empty texts have size 0 and take nothing. A null source is a source of its own,
last in order. Rows may repeat: each counts. An empty table gives an empty mix. Other columns and
their names do not matter.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cedarlog.llm.common import SPACE, materialise, words_between

#: Weights by the place of a source in code point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Bits of the hash, and of one level of buckets.
BITS, LEVEL = 60, 10
#: Every source's row is laid out this often, so that a join by source spreads a large source.
SALTS = 64
_INDEX_BITS = 33


def size_of(text: Column) -> Column:
    return F.size(words_between(text, SPACE)).cast("long")


def source_key(source: Column) -> Column:
    """A text that is never null and sorts as the sources do, null last."""
    return F.coalesce(F.concat(F.lit("a"), source.cast("string")), F.lit("z"))


def hash_of(id_col: Column, text: Column) -> Column:
    own = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    digest = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit("/"), own).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def sized_rows(documents: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return documents.select(
        F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("source_key"),
        size_of(F.col(text_col)).alias("size"), hash_of(F.col(id_col), F.col(text_col)).alias("hash"),
    )


def repeating_weights(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source_key, source_size, weight``, sources in code point order."""
    totals = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    ordered = materialise(
        totals.repartitionByRange("source_key").sortWithinPartitions("source_key")
        .withColumn("at", F.monotonically_increasing_id()),
        "sources",
    )
    part = F.shiftright("at", _INDEX_BITS)
    offsets, seen = [], 0
    for p, n in sorted(ordered.groupBy(part.alias("p")).count().collect()):  # a row for each partition
        offsets.append((p, seen))
        seen += n
    starts = ordered.sparkSession.createDataFrame(offsets or [(0, 0)], "p long, before long")
    place = F.col("before") + F.col("at").bitwiseAND((1 << _INDEX_BITS) - 1)
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (place % len(weights)).cast("int"))
    return ordered.join(starts, part == F.col("p")).select("source_key", "source_size", weight.alias("weight"))


def targets(sources: DataFrame, share: float = 1.0, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sources`` with their ``target``: each round a sum over all sources, until no other one is capped."""
    whole = lambda c: c.cast("decimal(38,0)")
    size, weight = F.col("source_size").cast("decimal(18,0)"), F.col("weight").cast("decimal(9,0)")
    total = sources.agg(F.sum(whole(F.col("source_size")))).first()[0] or 0
    budget = int(total) if share == 1.0 else int(int(total) * share)
    capped, known = F.lit(False), None
    while True:
        row = sources.agg(
            F.sum(F.when(capped, whole(F.col("source_size")))).alias("s"),
            F.sum(F.when(~capped, whole(F.col("weight")))).alias("w"),
        ).first()
        state = (int(row["s"] or 0), int(row["w"] or 0))
        free = budget - max_repeats * state[0]
        if state == known or not state[1]:
            break
        known = state
        capped = F.lit(Decimal(free)).cast("decimal(19,0)") * weight > size * F.lit(
            Decimal(max_repeats * state[1])
        ).cast("decimal(19,0)")
    shared = F.lit(float(free)) * F.col("weight").cast("double") / F.lit(float(max(known[1] if known else 1, 1)))
    most = (F.col("source_size") * max_repeats).cast("double")
    return sources.withColumn("target", F.when(capped, most).otherwise(shared))


def thresholds(sizes: DataFrame, aims: DataFrame) -> DataFrame:
    """``aims`` with ``base``, how often every document is taken, and ``cut``: hashes below it once more."""
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = materialise(
        aims.withColumn("base", base)
        .withColumn("rest", F.col("target") - F.col("base") * F.col("source_size"))
        .withColumn("prefix", F.lit(0).cast("long"))
        .withColumn("cut", F.lit(0).cast("long"))
        .withColumn("open", (F.col("rest") > 0)),
        "thresholds",
    )
    done = 0
    while done < BITS:
        left = BITS - done - LEVEL
        wanted = state.filter("open").select("source_key", "prefix", "rest")
        rows = sizes.withColumn("prefix", F.shiftright("hash", BITS - done)).join(wanted, ["source_key", "prefix"])
        histogram = rows.groupBy("source_key", F.shiftright("hash", left).alias("bucket")).agg(
            F.first("rest").alias("rest"), F.sum("size").alias("words"), F.count("*").alias("n")
        )
        upto = Window.partitionBy("source_key").orderBy("bucket")
        cumulated = histogram.withColumn("until", F.sum("words").over(upto)).withColumn(
            "before", F.col("until") - F.col("words")
        )
        # The first bucket that does not fit; sources of which everything fits have none.
        split = (
            cumulated.filter(F.col("until") > F.col("rest"))
            .groupBy("source_key")
            .agg(F.min(F.struct("bucket", "before", "until", "n")).alias("b"))
        )
        last = (F.col("b.n") == 1) | F.lit(left == 0) | (F.col("b.before") >= F.col("rest"))
        take = last & ((F.col("b.before") + F.col("b.until")) / 2 <= F.col("rest"))
        edge = F.col("b.bucket") + F.when(take, 1).otherwise(0)
        state = materialise(
            state.join(split, "source_key", "left").select(
                *aims.columns, "base",
                F.when(F.col("open") & F.col("b").isNotNull() & ~last, F.col("rest") - F.col("b.before")).otherwise(F.col("rest")).alias("rest"),
                F.coalesce(F.when(F.col("open"), F.col("b.bucket")), F.col("prefix")).alias("prefix"),
                F.when(~F.col("open"), F.col("cut"))
                .when(F.col("b").isNull(), F.lit(1 << BITS))
                .otherwise(F.shiftleft(edge, left)).alias("cut"),
                (F.col("open") & F.col("b").isNotNull() & ~last).alias("open"),
            ),
            "thresholds",
        )
        done += LEVEL
        if state.filter("open").isEmpty():
            break
    return state.select(*aims.columns, "base", "cut")


def _plan(sizes: DataFrame, sources: DataFrame, share: float, max_repeats: int) -> DataFrame:
    found = thresholds(sizes, targets(sources, share, max_repeats))
    return found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt() -> Column:
    return (F.col("hash") % SALTS).cast("int").alias("salt")


def _copies() -> Column:
    return F.col("base") + (F.col("hash") < F.col("cut")).cast("long")


def mix_sizes(documents: DataFrame, sources: DataFrame | None = None, share: float = 1.0,
              max_repeats: int = MAX_REPEATS, id_col: str = "doc_id", text_col: str = "text",
              source_col: str = "source") -> DataFrame:
    """``id, size, source_size, target, taken``: a row for each document; texts are read once.

    ``sources`` gives ``source_key, source_size, weight``; by default ``WEIGHTS`` repeat in source order.
    """
    sizes = materialise(sized_rows(documents, id_col, text_col, source_col), "sizes")
    plan = _plan(sizes, repeating_weights(sizes) if sources is None else sources, share, max_repeats)
    return sizes.withColumn("salt", _salt()).join(plan, ["source_key", "salt"]).select(
        "id", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken")
    )


def mix_documents(documents: DataFrame, share: float = 1.0, max_repeats: int = MAX_REPEATS,
                  id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``row, copy``: each document as a struct, once for every time it is taken; copies count from 1."""
    sizes = materialise(sized_rows(documents, id_col, text_col, source_col), "sizes")
    plan = _plan(sizes, repeating_weights(sizes), share, max_repeats)
    rows = documents.select(
        F.struct("*").alias("row"), source_key(F.col(source_col)).alias("source_key"), hash_of(F.col(id_col), F.col(text_col)).alias("hash")
    )
    return (
        rows.withColumn("salt", _salt()).join(plan, ["source_key", "salt"])
        .withColumn("copies", _copies().cast("int")).filter("copies > 0")
        .select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    )
