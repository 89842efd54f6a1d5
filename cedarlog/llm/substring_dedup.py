"""Substring deduplication over a compacted De Bruijn graph.

The edges of the graph are token k-mers. A window of ``WINDOW`` words is represented by the k-mer of
smallest hash among those inside it, so equal windows share that edge. Consecutive windows with the same
edge at the same place form a path section. Sections of equal content are one path: where an edge
has one path only, the graph does not branch there and the whole section is settled as a unit, by the
smallest source coordinate (document, word) among its occurrences. Where an edge has several paths,
their sections are unrolled into single windows, which are settled one by one in the same way. Each
word covered by a section or window that also starts earlier is removed; adjacent and overlapping ones form
the long repeated spans.

Only sections travel, about one for eight words. Each batch of documents settles its own repeats first, and of the
paths of an edge that branches within the batch only two go to the edge's group, so a passage or edge
that a third of all documents hold adds a few rows per batch to a group.

Words are runs without white space, taken as they are. Texts of fewer than ``WINDOW`` words, empty and null texts lose
nothing. Earlier means a smaller id (null first), then text hash, then word. Rows that agree in id and
text are one document given twice: each gets the same result. An empty table gives an empty result. Other
columns are carried along, whatever their names. Contents are compared by 128 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cedarlog.llm import text as tx
from cedarlog.llm.common import doc_key, materialise

WINDOW = 20
KMER = 5
_KEY = ["_id", "_text_hash"]
#: What is known of a span: nothing yet, that it goes, or that its windows must be told apart.
ASK, GONE, UNROLL = 0, 1, 2
_SALT = np.uint64(0xD1B54A32D192ED03)


def _words(raw: np.ndarray, bounds: np.ndarray, salt: np.uint64 | None = None):
    starts, ends = tx.runs(tx.NOT_SPACE[raw], bounds)
    words = tx.hash_runs(raw, starts, ends)
    return (words if salt is None else tx.mix(words ^ salt)), np.searchsorted(starts, bounds)


def _leftmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of the smallest, the first of equal ones."""
    best, at, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        a, b = slice(None, len(best) - step), slice(step, None)
        left = best[a] <= best[b]
        best, at = np.where(left, best[a], best[b]), np.where(left, at[a], at[b])
        span += step
    return at


def sections(words: np.ndarray, cut: np.ndarray):
    """Document, edge, path, first window (word in the document) and windows of every path section."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), np.zeros(0, np.uint64), none, none
    edges = tx.hash_windows(words, KMER)
    at = _leftmost_min(edges, WINDOW - KMER + 1)
    doc = np.searchsorted(cut, np.arange(n), side="right") - 1
    inside = np.arange(n) + WINDOW <= cut[doc + 1]
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    size = np.add.reduceat(inside.astype(np.int64), first) if len(first) else first
    # A path is told by the words of its section; powers restart in blocks, so hash each by place in it.
    total = tx._sums(tx.mix(words + _SALT) * tx._powers(tx._BASE, len(words)))
    end = first + size + WINDOW - 1
    path = tx.mix((total[end] - total[first]) * tx._powers(tx._INVERSE, len(words) + 1)[first] + size.astype(np.uint64) * _SALT)
    return doc[first], edges[at[first]], path, first - cut[doc[first]], size


def _codes(ids: pa.Array) -> np.ndarray:
    """Equal numbers for equal ids, null as well."""
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    return pa.compute.fill_null(ids.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)


def _coordinates(batch: pa.RecordBatch) -> np.ndarray:
    """The place of each row of a batch in the order of documents; equal for equal keys."""
    ids, hashes = batch.column(0), batch.column(1)
    keys = pa.table({"known": ids.is_valid(), "i": ids, "h": hashes})
    order = pa.compute.sort_indices(keys, [(c, "ascending") for c in ("known", "i", "h")]).to_numpy()
    code, h = _codes(ids)[order], hashes.to_numpy(zero_copy_only=False)[order]
    new = np.ones(len(order), bool)
    new[1:] = (code[1:] != code[:-1]) | (h[1:] != h[:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _first_copies(new: np.ndarray, *coordinate: np.ndarray) -> np.ndarray:
    """Rows at the coordinate of the first of their group: it, or a repeated row of the input.

    Rows are sorted by group and coordinate, ``new`` marks the first of each group.
    """
    other = new.copy()
    if len(new):
        other[1:] |= np.any([c[1:] != c[:-1] for c in coordinate], axis=0)
    return new[np.flatnonzero(other)][np.cumsum(other) - 1] if len(new) else new


def _per_document(batch: pa.RecordBatch, salt: np.uint64 | None = None):
    raw, bounds = tx.text_bytes(batch.column(2))
    for i, j in tx.blocks(bounds):
        yield i, *_words(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], salt)


def _emit(batch, doc, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    take = pa.array(doc)
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(take), batch.column(1).take(take), *[pa.array(c) for c in columns]], names=[*_KEY, *names]
    )


def _cut_sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [(i + s[0], *s[1:]) for i, words, cut in _per_document(batch) for s in [sections(words, cut)]]
        if not parts:
            continue
        doc, edge, path, start, size = (np.concatenate(c) for c in zip(*parts, strict=True))
        rank = _coordinates(batch)[doc]
        order = np.lexsort((start, rank, path, edge))
        e, p = edge[order], path[order]
        new = np.ones(len(order), bool)
        new[1:] = (e[1:] != e[:-1]) | (p[1:] != p[:-1])
        once = new | ~_first_copies(new, rank[order], start[order])
        order, e, p, new = order[once], e[once], p[once], new[once]
        state = np.where(new, ASK, GONE)
        # The third and later paths of an edge are known to branch off.
        opens = np.ones(len(order), bool)
        opens[1:] = e[1:] != e[:-1]
        nth = np.cumsum(new)
        nth -= np.repeat(nth[opens], np.diff(np.append(np.flatnonzero(opens), len(order))))
        state[new & (nth >= 2)] = UNROLL
        # What is settled goes anywhere.
        to = np.where(state == ASK, e, tx.mix(e + p + start[order].astype(np.uint64)))
        yield _emit(
            batch, doc[order],
            [tx.as_long(to), tx.as_long(p), start[order].astype(np.int32), size[order].astype(np.int32), state.astype(np.int8)],
            ["edge", "path", "start", "size", "state"],
        )


def _whole_groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Sorted batches anew, such that rows of one key are never parted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        last = 0
        if keys[0] != keys[-1]:
            last = len(keys) - int(np.argmax((keys != keys[-1])[::-1]))
            held.append(batch.slice(0, last))
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        elif held and held[-1].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy(zero_copy_only=False)


def _settle_sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by edge, path and coordinate."""
    for table in _whole_groups(batches, 2):
        edge, path, state = _column(table, "edge"), _column(table, "path"), _column(table, "state").copy()
        asked = state == ASK
        e, p, own = edge[asked], path[asked], state[asked]
        opens = np.ones(len(e), bool)
        opens[1:] = e[1:] != e[:-1]
        new = np.ones(len(e), bool)
        new[1:] = opens[1:] | (p[1:] != p[:-1])
        at = np.flatnonzero(opens)
        paths = np.repeat(np.add.reduceat(new.astype(int), at), np.diff(np.append(at, len(e)))) if len(e) else new
        first = _first_copies(new, _codes(table.column(0))[asked], _column(table, "_text_hash")[asked], _column(table, "start")[asked])
        own = np.where(~first, GONE, np.where(paths > 1, UNROLL, ASK))
        state[asked] = own
        told = pa.array(state != ASK)
        out = pa.table(
            [table.column(0), table.column(1), table.column("start"), table.column("size"), pa.array(state.astype(np.int8))],
            names=[*_KEY, "start", "size", "state"],
        ).filter(told)
        yield from out.to_batches()


def _cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the sections to unroll; of equal ones in a batch the first asks, the others go."""
    for batch in batches:
        lists = batch.column(3)
        first = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        flat = lists.flatten()
        start, size = (np.asarray(flat.field(k)) for k in (0, 1))
        parts = []
        for i, words, cut in _per_document(batch):
            j = i + len(cut) - 1
            a, b = first[i], first[j]
            n = size[a:b]
            doc = np.repeat(np.repeat(np.arange(i, j), np.diff(first[i : j + 1])), n)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pos = np.repeat(start[a:b], n) + nth
            at = pos + cut[doc - i]
            parts.append((doc, tx.hash_windows(words, WINDOW)[at], tx.hash_windows(tx.mix(words ^ _SALT), WINDOW)[at], pos))
        if not parts:
            continue
        doc, h1, h2, pos = (np.concatenate(c) for c in zip(*parts, strict=True))
        rank = _coordinates(batch)[doc]
        order = np.lexsort((pos, rank, h2, h1))
        h1, h2 = h1[order], h2[order]
        new = np.ones(len(order), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        once = new | ~_first_copies(new, rank[order], pos[order])
        order, h1, h2, new = order[once], h1[once], h2[once], new[once]
        to = np.where(new, h1, tx.mix(h1 + pos[order].astype(np.uint64)))
        state = np.where(new, ASK, GONE).astype(np.int8)
        yield _emit(
            batch, doc[order], [tx.as_long(to), tx.as_long(h2), pos[order].astype(np.int32), np.ones(len(order), np.int32), state],
            ["edge", "path", "start", "size", "state"],
        )


def _settle_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _whole_groups(batches, 2):
        edge, path, state = _column(table, "edge"), _column(table, "path"), _column(table, "state")
        asked = np.flatnonzero(state == ASK)
        e, p = edge[asked], path[asked]
        new = np.ones(len(e), bool)
        new[1:] = (e[1:] != e[:-1]) | (p[1:] != p[:-1])
        first = _first_copies(new, _codes(table.column(0))[asked], _column(table, "_text_hash")[asked], _column(table, "start")[asked])
        gone = state == GONE
        gone[asked[~first]] = True
        out = pa.table(
            [table.column(0), table.column(1), table.column("start"), table.column("size")], names=[*_KEY, "start", "size"]
        ).filter(pa.array(gone))
        yield from out.to_batches()


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("edge").sortWithinPartitions("edge", "path", *_KEY, "start")


def repeated_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _text_hash, spans``: windows that also start earlier, ``array<struct<start, size>>`` by
    word and number of windows, for each document that has any. Spans may overlap."""
    keyed = documents.select(*doc_key(id_col, text_col), F.col(text_col).alias("text"))
    kind = keyed.schema["_id"]
    rest = [T.StructField("start", T.IntegerType()), T.StructField("size", T.IntegerType())]
    state = T.StructField("state", T.ByteType())
    key = [kind, keyed.schema["_text_hash"]]
    group = [T.StructField("edge", T.LongType()), T.StructField("path", T.LongType())]
    cut = T.StructType([*key, *group, *rest, state])

    found = keyed.mapInArrow(_cut_sections, cut)
    settled = materialise(_sorted(found).mapInArrow(_settle_sections, T.StructType([*key, *rest, state])), "sections")
    gone = settled.filter(F.col("state") == GONE).drop("state")
    unroll = (
        settled.filter(F.col("state") == UNROLL)
        .groupBy(*_KEY)
        .agg(F.collect_list(F.struct("start", "size")).alias("list"))
        .select(F.col("_id").alias("_u_id"), F.col("_text_hash").alias("_u_hash"), "list")
    )
    asked = keyed.join(
        unroll, F.col("_id").eqNullSafe(F.col("_u_id")) & (F.col("_text_hash") == F.col("_u_hash"))
    ).select(*_KEY, "text", "list")
    windows = _sorted(asked.mapInArrow(_cut_windows, cut)).mapInArrow(_settle_windows, T.StructType([*key, *rest]))
    return gone.union(windows).groupBy(*_KEY).agg(F.collect_set(F.struct("start", "size")).alias("spans"))


def _without(text: pa.Array, spans: pa.Array) -> pa.Array:
    """Number of words, number removed, and the words left joined by blanks."""
    raw, bounds = tx.text_bytes(text)
    spans = spans.fill_null([]) if spans.null_count else spans
    first = np.asarray(spans.offsets)
    flat = spans.values
    start, size = (np.asarray(flat.field(k)).astype(np.int64) for k in (0, 1))
    whole = raw.tobytes()
    n_words, n_removed, kept = [], [], []
    for d in range(len(text)):
        words = whole[bounds[d] : bounds[d + 1]].split()
        a, b = first[d], first[d + 1]
        n, lost = len(words), 0
        if b > a:
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, start[a:b], 1)
            np.add.at(edge, start[a:b] + size[a:b] + WINDOW - 1, -1)
            stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
            lost = n - len(stay)
            words = [words[i] for i in stay]
        n_words.append(n)
        n_removed.append(lost)
        kept.append(b" ".join(words))
    return pa.StructArray.from_arrays(
        [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
        names=["n_words", "n_removed", "kept_text"],
    )


def dedup_substrings(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, n_words, n_removed, kept_text``: each input row as a struct, and what is left of its text."""
    spans = repeated_spans(documents, id_col, text_col).select(
        F.col("_id").alias("_s_id"), F.col("_text_hash").alias("_s_hash"), "spans"
    )
    rows = documents.select(*doc_key(id_col, text_col), F.struct("*").alias("row"))
    joined = rows.join(
        spans, F.col("_id").eqNullSafe(F.col("_s_id")) & (F.col("_text_hash") == F.col("_s_hash")), "left"
    )
    without = F.arrow_udf(_without, "struct<n_words:long,n_removed:long,kept_text:string>")
    return joined.select("row", without(F.col("row")[text_col], F.col("spans")).alias("out")).select("row", "out.*")
