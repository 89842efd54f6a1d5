"""Spelling variants: words one edit apart, by search schemes in FM-indexes of the vocabulary.

Two words one edit apart agree exactly in the first half of either one or in its second half (the
halves of the query). So each word is searched twice: its first half is matched exactly and the search goes on to the
right, allowing one error; its second half is matched exactly and the search goes on to the left. The two
directions are the two sides of a bidirectional index: one over the delimited vocabulary read backwards, one over it
read forwards (here: the same code over reversed words). Every step narrows an interval of suffix ranks
by one symbol, for all queries of a task at once; an interval that becomes empty ends its branch.

The vocabulary is sorted by range into shards of about ``SHARD_WORDS`` words, so all words with a common
first half lie in one shard or in neighbours. Only the first and last word of each shard come to the driver (one row
for ``SHARD_WORDS`` words). A task holds one shard of the index and the queries of one shard; queries
whose half reaches into further shards meet those in tasks of their own. No group grows with the
number of words that share a half.

Words: maximal runs of letters (``LETTERS``), only A-Z lower-cased; where the CRC-32 of ``<id>:<run>`` is
divisible by ``EVERY`` one code point is left out. Kept are results of at least ``MIN_CHARS`` code points that occur
at least ``MIN_COUNT`` times. Null and empty texts have no word; a null id counts as empty text. Repeated
rows count each time. Words of any length are taken whole. Equal counts are decided by code-point order.
An empty table gives an empty result. Only id and text are looked at, so other columns may have any name.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cedarlog.llm.common import lower_ascii, materialise
from cedarlog.operators.joins import broadcast_if_small

LETTERS = "A-Za-zÀ-ÿ"
MIN_CHARS, MIN_COUNT, EVERY = 7, 2, 31
#: A form occurs at least this many times as often as its variant.
TIMES = 10
SHARD_WORDS = 32_000
#: Intervals up to this size are read symbol by symbol; larger ones try the whole alphabet.
READ = 24
MARK = 1


def vocabulary(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n``: the words of all texts and how often they occur."""
    # Short runs cannot become words; the others are lower-cased one by one, as few have capitals.
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{min_chars},}}"), F.lit(0))
    found = documents.select(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":")).alias("id"), F.explode(runs).alias("run"))
    found = found.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), lower_ascii(F.col("run"))).otherwise(F.col("run")))
    crc = found.select("run", F.crc32(F.concat("id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = crc.select(F.when(F.col("h") % EVERY == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


class Index:
    """FM-index of words (bytes) for search from left to right, one suffix-rank interval per prefix."""

    def __init__(self, words: list[bytes]):
        text = np.frombuffer(bytes([MARK]) + b"".join(w + bytes([MARK]) for w in words), dtype=np.uint8)
        self.marks = np.flatnonzero(text == MARK)
        self.length = len(text)
        read = np.append(text[::-1], np.uint8(0))  # prefixes become suffixes
        self.suffixes = _suffix_array(read)
        self.last = read[self.suffixes - 1]
        self.n = len(read)
        order = np.argsort(self.last, kind="stable")
        self.places = self.last[order].astype(np.int64) * self.n + order
        self.alphabet = np.unique(text[text > MARK]).astype(np.int64)

    def step(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals after one more symbol; the number of smaller entries of ``places`` is C + Occ."""
        base = symbol.astype(np.int64) * self.n
        return np.searchsorted(self.places, base + lo), np.searchsorted(self.places, base + hi)

    def words_at(self, rank: np.ndarray) -> np.ndarray:
        """Number of the word whose closing mark begins at these suffix ranks."""
        return np.searchsorted(self.marks, self.length - 1 - self.suffixes[rank]) - 1


def _suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; the last symbol occurs once and is the smallest."""
    rank, k = text.astype(np.int64), 1
    while True:
        further = np.zeros_like(rank)
        further[:-k] = rank[k:] + 1
        key = rank * (len(text) + 258) + further
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]))
        if rank[order[-1]] == len(text) - 1:
            return order
        k *= 2


def search(index: Index, queries: list[bytes], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a query and an indexed word that is one edit away behind the first ``exact`` symbols."""
    flat = np.frombuffer(b"".join(q + bytes([MARK, 0]) for q in queries), dtype=np.uint8).astype(np.int64)
    size = np.array([len(q) for q in queries], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 2)])[:-1]
    q = np.arange(len(queries))
    lo, hi = index.step(np.zeros(len(q), np.int64), np.full(len(q), index.n), np.full(len(q), MARK))
    wide = [np.zeros(0, np.int64)] * 4  # one error made: query, next symbol, interval
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while len(q) or len(wide[0]):
        # What has its error must match the rest and the closing mark.
        eq, ep, elo, ehi = wide
        symbol = flat[begin[eq] + ep]
        elo, ehi = index.step(elo, ehi, symbol)
        live = ehi > elo
        done = live & (symbol == MARK)
        hits.append((eq[done], index.words_at(elo[done])))
        live &= ~done
        parts = [(eq[live], ep[live] + 1, elo[live], ehi[live])]
        # What has none yet may make it here.
        now = exact[q] <= at
        bq, blo, bhi = q[now], lo[now], hi[now]
        if len(bq):
            own, after = flat[begin[bq] + at], flat[begin[bq] + at + 1]
            parts.append(_delete(bq, blo, bhi, at, own, after))
            parts += _replace_or_insert(index, bq, blo, bhi, at, own)
        wide = [np.concatenate(x) for x in zip(*parts, strict=True)]
        # And goes on exactly.
        more = size[q] > at
        q, lo, hi = q[more], lo[more], hi[more]
        lo, hi = index.step(lo, hi, flat[begin[q] + at])
        live = hi > lo
        q, lo, hi = q[live], lo[live], hi[live]
        at += 1
    return tuple(np.concatenate(x) for x in zip(*hits, strict=True)) if hits else (np.zeros(0, np.int64),) * 2


def _delete(q, lo, hi, at: int, own, after):
    """The word lacks this symbol; of equal ones in a row the last is meant."""
    take = (own != MARK) & (own != after)
    return q[take], np.full(take.sum(), at + 1), lo[take], hi[take]


def _replace_or_insert(index: Index, q, lo, hi, at: int, own):
    """Every other symbol that follows in the interval: in place of this one, or before it."""
    few = hi - lo <= READ
    count = (hi - lo)[few]
    row = np.repeat(np.flatnonzero(few), count)
    place = np.repeat(lo[few], count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    found = np.unique(row * 256 + index.last[place])
    many = np.flatnonzero(~few)
    row = np.concatenate([found // 256, np.repeat(many, len(index.alphabet))])
    symbol = np.concatenate([found % 256, np.tile(index.alphabet, len(many))])
    keep = (symbol > MARK) & (symbol != own[row])
    row, symbol = row[keep], symbol[keep]
    new_lo, new_hi = index.step(lo[row], hi[row], symbol)
    live = new_hi > new_lo
    row, new_lo, new_hi = row[live], new_lo[live], new_hi[live]
    inside = own[row] != MARK
    return [
        (q[row][inside], np.full(inside.sum(), at + 1), new_lo[inside], new_hi[inside]),
        (q[row], np.full(len(row), at), new_lo, new_hi),
    ]


def _exact(length, backwards: bool):
    """How much of a word is matched exactly: its first half, or read backwards its second."""
    return length - length // 2 if backwards else length // 2


def _matches(queries: pa.Table, words: pa.Table, backwards: bool) -> pa.Table:
    asked = [w.encode("latin-1") for w in queries["s"].to_pylist()]
    held = [w.encode("latin-1") for w in words["s"].to_pylist()]
    exact = _exact(np.array([len(w) for w in asked], dtype=np.int64), backwards)
    who, what = search(Index(held), asked, exact) if held and asked else ([], [])
    way = -1 if backwards else 1
    return pa.table({
        "word": pa.array([asked[i][::way].decode("latin-1") for i in who], pa.string()),
        "near": pa.array([held[i][::way].decode("latin-1") for i in what], pa.string()),
    })


def _route(lows: list[str], highs: list[str], backwards: bool):
    """Each word, read in its direction, once for every shard that may hold words with its exact half."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            words, own = batch["s"].to_pylist(), batch["shard"].to_pylist()
            out = ([], [], [])
            for w, home in zip(words, own, strict=True):
                half = w[: _exact(len(w), backwards)]
                for k in range(bisect_left(highs, half), bisect_left(lows, half + "\U0010ffff")):
                    for column, v in zip(out, (w, k, home), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], ["s", "shard", "home"]
            )

    return run


def _one_way(words: DataFrame, shards: int, backwards: bool) -> DataFrame:
    s: Column = F.reverse("word") if backwards else F.col("word")
    placed = words.select(s.alias("s")).repartitionByRange(shards, "s").withColumn("part", F.spark_partition_id())
    placed = materialise(placed, "spelling-shards")
    bounds = placed.groupBy("part").agg(F.min("s").alias("low"), F.max("s").alias("high")).orderBy("part").collect()
    number = {b["part"]: k for k, b in enumerate(bounds)}
    lows, highs = [b["low"] for b in bounds], [b["high"] for b in bounds]
    if not bounds:
        return words.select("word", F.col("word").alias("near")).limit(0)
    part = F.get(F.lit([number.get(p, -1) for p in range(max(number) + 1)]).cast("array<int>"), F.col("part"))
    placed = placed.select("s", part.alias("shard"))
    routed = materialise(placed.mapInArrow(_route(lows, highs, backwards), "s string, shard int, home int"), "spelling-queries")
    pairs = materialise(routed.select("shard", "home").distinct(), "spelling-tasks")
    tasks = pairs.count()
    held = placed.join(broadcast_if_small(pairs), "shard").repartition(tasks, "shard", "home")
    asked = routed.repartition(tasks, "shard", "home")

    def match(queries: pa.Table, words: pa.Table) -> pa.Table:
        return _matches(queries, words, backwards)

    return asked.groupBy("shard", "home").cogroup(held.groupBy("shard", "home")).applyInArrow(match, "word string, near string")


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``word, near``: all ordered pairs of different words of ``words`` that one edit turns into each other."""
    shards = max(1, -(-words.count() // shard_words))
    return _one_way(words, shards, False).union(_one_way(words, shards, True)).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` by pointer jumping; counts grow tenfold with each form, so a handful of rounds is enough."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "spelling-forms")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = now.join(further, "root", "left")
        if joined.filter("next IS NOT NULL").isEmpty():
            return now
        now = materialise(joined.select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")


def variants(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
             min_count: int = MIN_COUNT, times: int = TIMES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for each word of the vocabulary."""
    words = materialise(vocabulary(documents, id_col, text_col, min_chars, min_count), "spelling-words")
    near = materialise(near_words(words, shard_words), "spelling-near")
    best = near.join(words.select(F.col("word").alias("near"), F.col("n").alias("m")), "near").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best")
    )
    found = words.join(best, "word", "left")
    far = -F.col("best.m") >= times * F.col("n")
    found = materialise(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(far, F.col("best.near")).alias("form"), F.when(far, -F.col("best.m")).alias("form_n"),
    ), "spelling-found")
    roots = _roots(found.filter("form IS NOT NULL"))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
