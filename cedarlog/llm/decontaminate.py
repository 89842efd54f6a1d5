"""Benchmark decontamination by a prefix-filtered set join, with DataFrame operations only.

A window is ``size`` consecutive words of an item, or the whole item if it has fewer. A shingle is one
word, so that every window has one. All shingles of the windows are counted over the documents; in
this order of rarity the prefix a window needs for exact containment is its rarest shingle, and
windows with a shingle that no document holds are gone. Documents join on prefix shingles alone. A
match says where the window would start: positional and length bounds ask that it begin and end
inside the document, then the words in that place are compared with the window exactly.

Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. Null and empty
texts have no words: such documents are clean, such items have no window. Items without an id are
searched for but not listed. Rows that agree in id and text are one document given twice: each is
returned with the same result. Ids and names of other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cedarlog.llm.common import MARKS, doc_key, lower_ascii, materialise, words_between

WINDOW = 10
#: Windows are sent to all executors up to this many bytes; beyond it documents are shuffled by word.
MAX_BROADCAST_BYTES = 64 << 20
_KEY = ["_id", "_text_hash"]


def words(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    # All-ASCII texts take the cheaper general lower-casing, which then does the same.
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(lower_ascii(text))
    return words_between(lower, MARKS)


def windows(items: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``window, items``: every distinct window with the ids of the items that hold it."""
    listed = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    each = F.when(F.size("w") <= size, F.array("w")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))
    )
    return (
        listed.select("item", F.explode(each).alias("window"))
        .groupBy("window")
        .agg(F.collect_set("item").alias("items"))
    )


def _bytes(df: DataFrame, text: Column, listed: Column | None = None) -> int:
    """About the size of ``df`` with a text column, and with a list of ids of which each counts 32 bytes."""
    size = F.octet_length(text) + (0 if listed is None else 32 * F.size(listed))
    row = df.agg(F.count("*").alias("n"), F.sum(size.cast("long")).alias("b")).first()
    return 100 * row["n"] + (row["b"] or 0)


def prefixes(documents: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """``token, at, window, items``: each window under its rarest word, which stands at ``at``."""
    vocabulary = wanted.select(F.explode("window").alias("token")).distinct()
    small = _bytes(vocabulary, F.col("token")) <= MAX_BROADCAST_BYTES
    if small:
        vocabulary = F.broadcast(vocabulary)
    counted = (
        documents.select(F.explode(words(F.col(text_col))).alias("token"))
        .join(vocabulary, "token", "left_semi")
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    if small:  # no larger than the vocabulary
        counted = F.broadcast(counted)
    keyed = wanted.withColumn("id", F.xxhash64("window"))
    rarest = (
        keyed.select("window", "items", F.posexplode("window").alias("at", "token"))
        .join(counted, "token", "left")
        .groupBy("window")
        .agg(
            F.first("items").alias("items"),
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "at")).alias("rarest"),
        )
    )
    return rarest.filter("rarest.n > 0").select("rarest.token", "rarest.at", "window", "items")


def _starts() -> dict[str, Column]:
    return {"start": F.col("pos") - F.col("at"), "length": F.size("window")}


def _search_small(texts: DataFrame, prefix: DataFrame) -> DataFrame:
    """One pass: words meet the broadcast prefixes, and the document's own words verify in place."""
    # The closing empty word meets an entry of its own, so that each document gives a row.
    closing = texts.sparkSession.range(1).select(
        F.lit("").alias("token"), F.lit(0).alias("at"), F.lit(None).cast("array<string>").alias("window"),
        F.lit(None).cast(prefix.schema["items"].dataType).alias("items"),
    )
    probed = texts.select(
        *_KEY, "w", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "token")
    ).join(F.broadcast(prefix.unionByName(closing)), "token")
    start, length = F.col("pos") - F.col("at"), F.size("window")
    fits = (start >= 0) & (start + length <= F.size("w"))
    same = F.slice("w", start + 1, length) == F.col("window")
    ends = F.col("window").isNull()
    return probed.filter(ends | (fits & same)).select(
        *_KEY,
        F.when(ends, F.col("pos")).alias("n_words"),
        F.when(~ends, F.struct(start.alias("start"), length.alias("length"))).alias("hit"),
        "items",
    )


def _search_large(texts: DataFrame, prefix: DataFrame) -> DataFrame:
    """For windows beyond broadcasting: narrow word rows are shuffled, candidates go back to their texts."""
    word_rows = texts.select(*_KEY, F.size("w").alias("n"), F.posexplode("w").alias("pos", "token"))
    start, length = F.col("pos") - F.col("at"), F.size("window")
    candidates = (
        word_rows.join(prefix, "token")
        .filter((start >= 0) & (start + length <= F.col("n")))
        .groupBy(F.col("_id").alias("_c_id"), F.col("_text_hash").alias("_c_hash"))
        .agg(F.collect_set(F.struct(start.alias("start"), "window", "items")).alias("tried"))
    )
    joined = texts.join(
        candidates, F.col("_id").eqNullSafe(F.col("_c_id")) & (F.col("_text_hash") == F.col("_c_hash")), "left"
    ).withColumn(
        "found",
        F.filter("tried", lambda c: F.slice("w", c["start"] + 1, F.size(c["window"])) == c["window"]),
    )
    return joined.select(*_KEY, F.size("w").alias("n_words"), F.explode_outer("found").alias("f")).select(
        *_KEY, "n_words",
        F.when(F.col("f").isNotNull(), F.struct(F.col("f.start").alias("start"), F.size("f.window").alias("length"))).alias("hit"),
        F.col("f.items").alias("items"),
    )


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_col: str = "doc_id",
                  text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                  max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``_id, _text_hash, copies, n_words, n_hit, items``: a row for each distinct document; ``copies``
    rows of the input hold it, ``items`` are the ids (as sorted texts) of items with occurring windows."""
    wanted = materialise(windows(benchmark, size, item_id, item_text), "windows")
    prefix = materialise(prefixes(documents, wanted, text_col), "prefixes")
    texts = documents.select(*doc_key(id_col, text_col), words(F.col(text_col)).alias("w"))
    listed = F.array_join(F.flatten(F.array("window")), " ")
    if _bytes(prefix, listed, F.col("items")) <= max_broadcast_bytes:
        found, copies = _search_small(texts, prefix), F.count("n_words")
    else:
        counted = texts.groupBy(*_KEY).agg(F.first("w").alias("w"), F.count("*").alias("copies"))
        found, copies = _search_large(counted.drop("copies"), prefix), None
    grouped = found.groupBy(*_KEY).agg(
        *([copies.alias("copies")] if copies is not None else []),
        F.coalesce(F.max("n_words"), F.lit(0)).cast("long").alias("n_words"),
        F.collect_set("hit").alias("hits"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    if copies is None:
        sizes = counted.select(F.col("_id").alias("_s_id"), F.col("_text_hash").alias("_s_hash"), "copies")
        grouped = grouped.join(
            sizes, F.col("_id").eqNullSafe(F.col("_s_id")) & (F.col("_text_hash") == F.col("_s_hash"))
        ).drop("_s_id", "_s_hash")
    # Covered words by a sweep over the sorted hits.
    swept = F.aggregate(
        F.sort_array("hits"),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, h: F.struct(
            F.greatest(a["end"], h["start"] + h["length"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), h["start"] + h["length"] - F.greatest(a["end"], h["start"]))).alias("n"),
        ),
    )
    return grouped.select(
        *_KEY, "copies", "n_words", swept["n"].cast("long").alias("n_hit"),
        F.array_sort(F.transform("items", lambda i: i.cast("string"))).alias("items"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Documents without a word of any window, with their columns as they were."""
    hit = contamination(documents, benchmark, size, id_col, text_col).filter("n_hit > 0")
    keys = [c.alias(n) for c, n in zip(doc_key(id_col, text_col), ("_d_id", "_d_hash"), strict=True)]
    rows = documents.select(F.struct("*").alias("row"), *keys)
    clean = rows.join(
        hit, F.col("_d_id").eqNullSafe(F.col("_id")) & (F.col("_d_hash") == F.col("_text_hash")), "left_anti"
    )
    return clean.select("row.*")
