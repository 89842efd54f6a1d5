"""Document fingerprints by I-Match with several randomised lexicons.

The lexicon is a band of inverse document frequency, counted over all documents: terms that are neither in
more than ``MAX_SHARE`` of them nor in fewer than ``MIN_SHARE``. A lower bound that is a share keeps the lexicon
small at any size: it has at most (mean number of distinct terms of a document) / ``MIN_SHARE`` terms.
The distinct lexicon terms of a document, sorted, are hashed once as a whole and once for each of ``SUBSETS``
random parts of the lexicon. Parts come in sizes from a quarter to a 512th: of a long text a small part holds
about one term, which a change elsewhere leaves alone, and a short text has terms in the large parts. Likeness is the share of agreeing parts among those in which at
least one of two documents has a term.

Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. A text without a lexicon
term is hashed by its bytes and has no parts; it is like equal texts alone. Null texts count as empty.
Ids may be null (first in order) or repeat (then by text hash); an empty table gives an empty result; a single
document is its own next one. Other columns and their names do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cedarlog.llm import text as tx
from cedarlog.llm.common import doc_key, fresh

MIN_SHARE, MAX_SHARE = 0.001, 0.1
SUBSETS = 64
#: What part of the lexicon subset ``i`` holds: one in 2 to the ``PART_BITS[i % 8]``.
PART_BITS = (2, 5, 6, 7, 8, 8, 9, 9)
#: Sampled keys for each partition of the ordered documents; they only decide how evenly these are dealt.
SAMPLES = 40
#: Bytes of text that a range of the ordered documents aims at; more text makes more ranges.
RANGE_BYTES = 32 << 20
#: Documents that are text objects in one task at a time.
ROWS = 500
_SALT = 0xA24BAED4963EE407


def _terms(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and term of each distinct term, sorted by both."""
    starts, ends = tx.runs(tx.ALNUM[raw], bounds)
    words = tx.hash_runs(raw, starts, ends, tx.lower_codes())
    doc = np.searchsorted(bounds, starts, side="right") - 1
    order = np.lexsort((words, doc))
    words, doc = words[order], doc[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], words[new]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, bounds = tx.text_bytes(batch.column(0))
        parts = []
        for i, j in tx.blocks(bounds):
            parts.append(_terms(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])[1])
        if parts:
            term, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tx.as_long(term)), pa.array(n)], names=["term", "n"])


def lexicon(documents: DataFrame, text_col: str = "text", min_share: float = MIN_SHARE,
            max_share: float = MAX_SHARE) -> np.ndarray:
    """Sorted hashes of the terms in the band."""
    total = documents.count()
    counted = documents.select(F.col(text_col)).mapInArrow(_count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    band = counted.filter(F.col("n").between(min_share * total, max_share * total)).select("term")
    return np.sort(np.asarray([r[0] for r in band.toLocalIterator()], dtype=np.int64).view(np.uint64))


def subset_masks(terms: np.ndarray) -> np.ndarray:
    """For each term the parts of the lexicon it is in, one bit each."""
    masks = np.zeros(len(terms), np.uint64)
    for i in range(SUBSETS):
        share = np.uint64(1 << (64 - PART_BITS[i % 8]))
        inside = tx.mix(terms + np.uint64(_SALT * (i + 1) & tx._M)) < share
        masks |= inside.astype(np.uint64) << np.uint64(i)
    return masks


def fingerprint(texts: pa.Array, terms: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash over the whole lexicon, and by part of it (0: no term of the document is in it)."""
    whole, parts = np.zeros(len(texts), np.uint64), np.zeros((len(texts), SUBSETS), np.uint64)
    raw, bounds = tx.text_bytes(texts)
    for i, j in tx.blocks(bounds):
        own, at = raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        doc, term = _terms(own, at)
        place = np.searchsorted(terms, term)
        known = place < len(terms)
        known[known] = terms[place[known]] == term[known]
        doc, term, mask = doc[known], term[known], masks[place[known]]
        first = np.searchsorted(doc, np.arange(j - i + 1))
        some = first[1:] > first[:-1]
        if some.any():
            # Sets are hashed by the sum of their mixed terms.
            value, heads = tx.mix(term ^ np.uint64(_SALT)), first[:-1][some]
            whole[i:j][some] = tx.mix(np.add.reduceat(value, heads)) | np.uint64(1)
            for k in range(SUBSETS):
                inside = (mask >> np.uint64(k)) & np.uint64(1)
                sums = np.add.reduceat(value * inside, heads)
                parts[i:j, k][some] = np.where(sums == 0, 0, (tx.mix(sums) & np.uint64(0xFFFFFFFF)) | np.uint64(1))
        bare = np.flatnonzero(~some)
        whole[i:j][bare] = tx.hash_runs(own, at[:-1][bare], at[1:][bare]) & ~np.uint64(1)
    return whole, parts


def as_texts(whole: np.ndarray, parts: np.ndarray) -> list[str]:
    return [f"{w:016x}" + "".join(f"{p:08x}" for p in row) for w, row in zip(whole.tolist(), parts.tolist(), strict=True)]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints."""
    held = (a[1] > 0) | (b[1] > 0)
    same = ((a[1] == b[1]) & held).sum(axis=1)
    n = held.sum(axis=1)
    return np.where(a[0] == b[0], 1.0, np.where(n > 0, same / np.maximum(n, 1), 0.0))


def _before(keys: pa.Table, splits: pa.Table) -> np.ndarray:
    """How many of ``splits`` are not after each key."""
    both = pa.concat_tables([splits, keys]).append_column(
        "row", pa.array(np.arange(len(splits) + len(keys)) >= len(splits))
    )
    by = [(c, "ascending") for c in ("known", "id", "hash", "row")]
    order = pc.sort_indices(both, by).to_numpy()
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(order < len(splits))
    return out[len(splits) :]


def _table(ids: pa.Array, hashes: pa.Array) -> pa.Table:
    return pa.table({"known": pc.is_valid(ids), "id": ids, "hash": hashes})


def in_order(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``to, guest, _id, _text_hash, text``: documents dealt into ordered ranges ``to`` and sorted in them.

    The first document of each range is also the last, as a guest, of the range before (the first
    range's: of the last range), so that every document meets its next one.
    """
    keyed = documents.select(*doc_key(id_col, text_col), F.col(text_col).alias("text"))
    spark = documents.sparkSession
    total, size = keyed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES), 1)
    kind = pa.int64() if keyed.schema["_id"].dataType == T.LongType() else None
    sample = keyed.select("_id", "_text_hash").sample(min(1.0, SAMPLES * ranges / max(total, 1)), 7).collect()
    drawn = _table(pa.array([r[0] for r in sample], kind), pa.array([r[1] for r in sample], pa.int64()))
    if kind is None and not len(sample):
        ranges = 1
    order = pc.sort_indices(drawn, [(c, "ascending") for c in ("known", "id", "hash")]).to_numpy()
    picked = order[np.linspace(0, len(order), ranges, endpoint=False).astype(int)[1:]] if len(order) else order
    splits = drawn.take(pa.array(np.unique(picked))) if len(order) else None

    def place(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        if splits is None:
            return pa.array(np.zeros(len(ids), np.int32))
        own = _table(ids, hashes)
        return pa.array(_before(own, splits.cast(own.schema)).astype(np.int32))

    ranged = keyed.select("_id", "_text_hash").withColumn("range", F.arrow_udf(place, "int")("_id", "_text_hash"))
    heads = ranged.groupBy("range").agg(
        F.min(F.struct(F.col("_id").isNotNull().alias("known"), "_id", "_text_hash")).alias("head")
    )
    rows = sorted((r["range"], r["head"]["_id"], r["head"]["_text_hash"]) for r in heads.collect())  # one per range
    into = {(i, h): (r, rows[k - 1][0]) for k, (r, i, h) in enumerate(rows)} if len(rows) > 1 else {}

    def targets(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        own = place(ids, hashes).to_pylist()
        keys = zip(ids.to_pylist(), hashes.to_pylist(), strict=True)
        return pa.array(
            [[r, into[k][1]] if k in into else [r] for r, k in zip(own, keys, strict=True)], pa.list_(pa.int32())
        )

    dealt = keyed.select(
        F.posexplode(F.arrow_udf(targets, "array<int>")("_id", "_text_hash")).alias("guest", "to"), *keyed.columns
    )
    return dealt.repartition(ranges, "to").sortWithinPartitions("to", "guest", "_id", "_text_hash").select(
        "to", "guest", "_id", "_text_hash", "text"
    )


def edit(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(documents: DataFrame, terms: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""
    ordered = in_order(documents, id_col, text_col)
    shared = documents.sparkSession.sparkContext.broadcast(terms)
    schema = T.StructType(
        [T.StructField("id", ordered.schema["_id"].dataType), T.StructField("n_chars", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")]
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, masks = shared.value, subset_masks(shared.value)

        def result(ids: pa.Array, chain: list[str], follows: list[int]) -> pa.RecordBatch:
            """``chain`` begins with the texts of ``ids``; ``follows`` says where each one's next stands."""
            n = len(ids)
            all_ = fingerprint(pa.array(chain, pa.string()), terms, masks)
            edited = [edit(t, chain[f]) for t, f in zip(chain[:n], follows, strict=True)]
            own = (all_[0][:n], all_[1][:n])
            changed = fingerprint(pa.array(edited, pa.string()), terms, masks)
            at = np.asarray(follows)
            return pa.RecordBatch.from_arrays(
                [
                    ids, pa.array([len(t) for t in chain[:n]], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                    pa.array(as_texts(*own)), pa.array(as_texts(*changed)),
                    pa.array(likeness(own, changed)), pa.array(likeness(own, (all_[0][at], all_[1][at]))),
                ],
                names=schema.names,
            )

        group, head, last = None, "", None  # of the range at hand: its first text, and the row that waits for its next
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS)):
            to, guest = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [t or "" for t in batch.column(4).to_pylist()]
            ids, chain, waiting = [], [], []
            extra: list[tuple[int, str]] = []

            def settle(row, following: str) -> None:
                if row is not None:
                    ids.append(row[0])
                    chain.append(row[1])
                    waiting.append(following)

            for k, (r, g) in enumerate(zip(to, guest, strict=True)):
                if r != group:
                    settle(last, head)
                    group, head, last = r, texts[k], None
                settle(last, texts[k])
                last = None if g else (batch.column(2)[k], texts[k])
            if ids:
                n = len(ids)
                follows = []
                for k in range(n):
                    if k + 1 < n and chain[k + 1] is waiting[k]:
                        follows.append(k + 1)
                    else:
                        extra.append((k, waiting[k]))
                        follows.append(n + len(extra) - 1)
                kind = batch.column(2).type
                yield result(pa.array([i.as_py() for i in ids], kind), chain + [t for _, t in extra], follows)
        if last is not None:
            kind = last[0].type
            yield result(pa.array([last[0].as_py()], kind), [last[1], head], [1])

    return ordered.mapInArrow(compare, schema)


def fingerprints(documents: DataFrame, terms: np.ndarray, text_col: str = "text") -> DataFrame:
    """The documents with ``fingerprint``, against a given lexicon."""
    shared = documents.sparkSession.sparkContext.broadcast(terms)

    def mark(column: pa.Array) -> pa.Array:
        return pa.array(as_texts(*fingerprint(column, shared.value, subset_masks(shared.value))))

    (name,) = fresh(documents, "fingerprint")
    return documents.withColumn(name, F.arrow_udf(mark, "string")(F.col(text_col)))
