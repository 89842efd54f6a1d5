"""Near-duplicate documents by DartMinHash signatures and banded joins.

A document is the weighted set of its five-word shingles, weighted by how often each occurs. Darts are
thrown at the plane of weight and rank over every shingle: cells with borders at powers of two get a
Poisson number of darts from a hash of shingle and cell, each with a coordinate, a weight and a rank. A dart
hits if its weight is below the shingle's. The earliest rank per coordinate is the signature, so two
documents agree in a coordinate with the probability of their weighted Jaccard similarity. The
number of rank cells follows from the total weight: about as many darts hit for a short text as for a long one.

Documents with equal words are one text. Bands of the signature are joined: the texts of a bucket meet its most
central member, and every such pair is verified by exact similarity. Components of the links so far are
found. Texts that share a bucket across two components may still be linked; they meet once more by an exact
prefix join: with shingles in order of rarity, two texts at 0.8 share one among the rarest ninth of the
shorter and the rarest fifth of the longer, at places that leave room for the overlap. So no pair inside a component is
compared again, a large group of copies edited each in its own way is not expanded into pairs, and no
link between different components is lost whose texts are in a bucket (at 0.8, all but one in 100,000).

Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased; fewer than five words are
one shingle. Texts without words are linked only if they are equal (null as empty). Repeated rows belong to one
class. Ids may be null or repeat: the class is named by its first document, the smallest id (null last), then
text hash. An empty table gives an empty result; other columns and their names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cedarlog.llm import text as tx
from cedarlog.llm.common import doc_key, materialise
from cedarlog.llm.graph import connected_components, extended
from cedarlog.operators.joins import join_by_weight

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 30, 5
COORDINATES = BANDS * ROWS
#: Expected darts of a document; with fewer, some coordinate may stay empty.
DARTS = int(COORDINATES * (np.log(COORDINATES) + 3))
#: The first rank cell; the others double.
FIRST_RANK = 2.0**-4
_KEY = ["_id", "_text_hash"]
_C = [np.uint64(0x9E3779B97F4A7C15 * i & tx._M | 1) for i in range(1, 8)]


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(float) * 2.0**-53


def _poisson(area: float, cache: dict = {}) -> np.ndarray:  # noqa: B006
    """Cumulated probabilities of 0, 1, 2 ... darts."""
    if area not in cache:
        n = np.arange(int(area + 12 * np.sqrt(area) + 12))
        log = n * np.log(area) - area - np.concatenate([[0.0], np.cumsum(np.log(np.maximum(n[1:], 1)))])
        cache[area] = np.cumsum(np.exp(log))
    return cache[area]


def shingles(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of consecutive documents, and where each document's begin."""
    starts, ends = tx.runs(tx.ALNUM[raw], bounds)
    words = tx.hash_runs(raw, starts, ends, tx.lower_codes())
    cut = np.searchsorted(starts, bounds)
    n = np.diff(cut)
    all_ = tx.hash_windows(words, SHINGLE)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(int))
    first = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(first[-1]) - np.repeat(first[:-1], count) + np.repeat(cut[:-1], count)
    out = np.zeros(first[-1], np.uint64)
    whole = np.repeat(n >= SHINGLE, count)
    out[whole] = all_[at[whole]]
    for d in np.flatnonzero((n > 0) & (n < SHINGLE)):
        out[first[d]] = tx.hash_windows(words[cut[d] : cut[d + 1]], int(n[d]))[0] ^ np.uint64(n[d])
    return out, first


def weighted(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, shingle and weight of each distinct shingle of a document."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return d[at], h[at], np.diff(np.append(at, len(h)))


def _throw(doc, element, weight, cells, out) -> None:
    """Lower ``out[document, coordinate]`` to the smallest rank of the darts that hit.

    ``cells`` is the number of rank cells of each document.
    """
    k = out.shape[1]
    flat = out.reshape(-1)
    nu = 0
    while True:
        low = 0.0 if nu == 0 else 2.0 ** (nu - 1)
        reach = weight > low
        if not reach.any():
            return
        d1, e1, w1 = doc[reach], element[reach], weight[reach]
        for rho in range(int(cells[d1].max())):
            inside = cells[d1] > rho
            d, e, w = d1[inside], e1[inside], w1[inside]
            rank_low = 0.0 if rho == 0 else FIRST_RANK * 2.0 ** (rho - 1)
            rank_size = FIRST_RANK if rho == 0 else rank_low
            weight_size = 1.0 if nu == 0 else low
            place = np.uint64((nu * int(_C[1]) + (rho + 1) * int(_C[2])) & tx._M)
            cell = tx.mix(e * _C[0] + place)
            n = np.searchsorted(_poisson(rank_size * weight_size), _unit(cell), side="right")
            some = n > 0
            n = n[some]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            dart = tx.mix(np.repeat(cell[some], n) + (nth.astype(np.uint64) + np.uint64(1)) * _C[3])
            hit = low + weight_size * _unit(tx.mix(dart + _C[4])) < np.repeat(w[some], n)
            dart, own = dart[hit], np.repeat(d[some], n)[hit]
            rank = rank_low + rank_size * _unit(tx.mix(dart + _C[5]))
            np.minimum.at(flat, own * k + (dart % np.uint64(k)).astype(np.int64), rank)
        nu += 1


def signatures(doc, element, weight, docs: int, k: int = COORDINATES, darts: int = DARTS) -> np.ndarray:
    """The smallest rank per document and coordinate; NaN for documents without shingles."""
    out = np.full((docs, k), np.inf)
    total = np.bincount(doc, weight, minlength=docs)
    todo = total > 0
    while todo.any():
        reach = np.maximum(darts / np.maximum(total, 1e-9) / FIRST_RANK, 1)
        cells = np.where(todo, 1 + np.ceil(np.log2(reach)), 0).astype(int)
        mine = todo[doc]
        _throw(doc[mine], element[mine], weight[mine], cells, out)
        todo &= np.isinf(out).any(axis=1)
        darts *= 2
    out[total == 0] = np.nan
    return out


def _content(hashes: np.ndarray, first: np.ndarray, raw: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """128 bits that stand for a document's words, or for its bytes if it has none."""
    two = []
    for c in (_C[0], _C[6]):
        place = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))
        total = tx._sums(tx.mix(hashes + c) * (place.astype(np.uint64) * c | np.uint64(1)))
        two.append(tx.mix((total[first[1:]] - total[first[:-1]]) ^ np.diff(first).astype(np.uint64)))
    empty = np.flatnonzero(np.diff(first) == 0)
    if len(empty):
        for i, c in enumerate((_C[1], _C[2])):
            h = tx.hash_runs(raw, bounds[:-1][empty], bounds[1:][empty], tx.BYTE_CODES * c)
            two[i][empty] = tx.mix(h ^ c)
    pairs = np.stack(two, axis=1).tobytes()
    return [pairs[16 * i : 16 * i + 16] for i in range(len(first) - 1)]


def _bands(signature: np.ndarray) -> np.ndarray:
    bits = signature.view(np.uint64)
    out = np.empty((len(bits), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(bits), (b + 1) * int(_C[3]) & tx._M, np.uint64)
        for r in range(ROWS):
            h = tx.mix(h + bits[:, b * ROWS + r] * _C[r])
        out[:, b] = h
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, bounds = tx.text_bytes(batch.column(2))
        for i, j in tx.blocks(bounds):
            part, own = raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            hashes, first = shingles(part, own)
            doc, element, weight = weighted(hashes, first)
            bands = _bands(signatures(doc, element, weight, j - i))
            n = np.diff(first)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]), pa.int32()),
                pa.array(tx.as_long(bands[n > 0].reshape(-1))),
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[i:j], batch.column(1)[i:j],
                    pa.array(_content(hashes, first, part, own), pa.binary()), pa.array(n, pa.int64()), lists,
                ],
                names=["_id", "_text_hash", "content", "n", "bands"],
            )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs whose weighted Jaccard similarity reaches the bound."""
    for batch in batches:
        keep = np.zeros(len(batch), bool)
        raw_a, at_a = tx.text_bytes(batch.column(2))
        raw_b, at_b = tx.text_bytes(batch.column(3))
        for i, j in tx.blocks(at_a):
            for p, q in tx.blocks(at_b[i : j + 1] - at_b[i]):
                p, q = i + p, i + q
                sides = []
                for raw, at in ((raw_a, at_a), (raw_b, at_b)):
                    hashes, first = shingles(raw[at[p] : at[q]], at[p : q + 1] - at[p])
                    sides.append((weighted(hashes, first), np.diff(first)))
                (da, ha, wa), na = sides[0]
                (db, hb, wb), nb = sides[1]
                d, h, w = np.concatenate([da, db]), np.concatenate([ha, hb]), np.concatenate([wa, wb])
                order = np.lexsort((h, d))
                d, h, w = d[order], h[order], w[order]
                both = np.flatnonzero((d[1:] == d[:-1]) & (h[1:] == h[:-1]))
                common = np.bincount(d[both], np.minimum(w[both], w[both + 1]), minlength=q - p)
                keep[p:q] = common >= SIMILARITY * (na + nb - common) - 1e-9
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep))


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each occurrence of a shingle in a text as an element of its own, so that weights become sets."""
    for batch in batches:
        raw, bounds = tx.text_bytes(batch.column(1))
        node = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j in tx.blocks(bounds):
            doc, element, weight = weighted(*shingles(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]))
            nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
            each = tx.mix(np.repeat(element, weight) + nth.astype(np.uint64) * _C[6])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(node[i + doc], weight)), pa.array(tx.as_long(each))], names=["node", "element"]
            )


def _prefixes(texts: DataFrame) -> DataFrame:
    """``bucket, content, n, place, short``: the elements of each text's prefix, rarest among ``texts`` first.

    ``place`` counts the elements before it; ``short`` marks the part that suffices against longer texts.
    """
    numbered = texts.select("content", "n", F.xxhash64("content").alias("node"), "text")
    elements = numbered.select("node", "text").mapInArrow(_elements, "node long, element long")
    counted = elements.groupBy("element").agg(F.count("*").alias("texts"))
    ranked = (
        elements.join(counted, "element")
        .groupBy("node")
        .agg(F.array_sort(F.collect_list(F.struct("texts", "element"))).alias("e"))
        .withColumn("n", F.size("e"))
    )
    longest = F.col("n") - F.ceil(SIMILARITY * F.col("n") - 1e-9) + 1
    shortest = F.col("n") - F.ceil(2 * SIMILARITY / (1 + SIMILARITY) * F.col("n") - 1e-9) + 1
    rows = ranked.select(
        "node", shortest.alias("few"), F.posexplode(F.slice("e", F.lit(1), longest.cast("int"))).alias("place", "x")
    )
    return numbered.select("node", "content", "n").join(rows, "node").select(
        F.col("x.element").alias("bucket"), "content", "n", "place", (F.col("place") < F.col("few")).alias("short")
    )


def _across(placed: DataFrame) -> DataFrame:
    """``u, v``: pairs of different ``root`` that share a prefix element and can reach the bound."""
    # A component stands in a bucket as one row with its extremes, so its members do not meet each other.
    groups = placed.groupBy("bucket", F.col("root").alias("other")).agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("place").alias("soonest")
    )
    share = SIMILARITY / (1 + SIMILARITY)
    a = placed.filter("short").select(
        F.col("bucket").alias("a_bucket"), F.col("root").alias("a_root"), F.col("content").alias("a"),
        F.col("n").alias("a_n"), F.col("place").alias("a_at"),
    )
    shortest = F.greatest("a_n", "least")
    may_fit = (
        (F.col("a_root") != F.col("other")) & (F.col("a_n") <= F.col("most")) & (F.col("a_n") >= SIMILARITY * F.col("least"))
        & (F.col("a_n") - F.col("a_at") >= share * (F.col("a_n") + shortest) - 1e-9)
        & (F.col("most") - F.col("soonest") >= share * (F.col("a_n") + shortest) - 1e-9)
    )
    met = a.join(groups, (F.col("a_bucket") == F.col("bucket")) & may_fit).select(
        F.col("bucket").alias("m_bucket"), F.col("other").alias("m_root"), "a", "a_n", "a_at"
    )
    shared = share * (F.col("a_n") + F.col("n")) - 1e-9
    fits = (
        (F.col("a_n") <= F.col("n")) & (F.col("a_n") >= SIMILARITY * F.col("n"))
        & (F.col("a_n") - F.col("a_at") >= shared) & (F.col("n") - F.col("place") >= shared)
    )
    on = (F.col("m_bucket") == F.col("bucket")) & (F.col("m_root") == F.col("root")) & fits
    return met.join(placed, on).select(F.greatest("a", "content").alias("u"), F.least("a", "content").alias("v")).distinct()


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The verified ones of ``pairs`` (``u, v``)."""
    u = texts.select(F.col("content").alias("u"), F.col("text").alias("u_text"), F.col("n").alias("u_n"))
    v = texts.select(F.col("content").alias("v"), F.col("text").alias("v_text"), F.col("n").alias("v_n"))
    alike = (F.col("u_n") >= SIMILARITY * F.col("v_n")) & (F.col("v_n") >= SIMILARITY * F.col("u_n"))
    joined = pairs.join(u, "u").join(v, "v").filter(alike).select("u", "v", "u_text", "v_text")
    return joined.mapInArrow(_verify, "u binary, v binary")


def _ordered(keys: list[str]) -> F.Column:
    return F.struct(F.col(keys[0]).isNull().alias("no_id"), *keys)


def _mixed(placed: DataFrame) -> DataFrame:
    """Members of buckets that reach over several components."""
    several = placed.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b")
    return placed.join(several, "bucket", "left_semi")


def classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _text_hash, class_id, class_hash, class_size``: the key of every distinct document, the
    key of its class's first document, and the number of distinct documents in the class."""
    source = documents.select(*doc_key(id_col, text_col), F.col(text_col).alias("text"))
    kinds = source.schema
    schema = T.StructType(
        [kinds["_id"], kinds["_text_hash"], T.StructField("content", T.BinaryType()), T.StructField("n", T.LongType()),
         T.StructField("bands", T.ArrayType(T.LongType()))]
    )
    signed = materialise(source.mapInArrow(_sign, schema), "signatures")
    nodes = signed.groupBy("content").agg(
        F.min(_ordered(_KEY)).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    entries = nodes.select("content", F.explode("bands").alias("bucket"))
    shared = materialise(entries.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    members = materialise(entries.join(shared, "bucket"), "members")

    # A text that shares large buckets in many bands is close to many: the best one to compare with.
    central = members.groupBy("content").agg(F.sum("size").alias("reach"))
    members = materialise(members.drop("size").join(central, "content"), "members")
    leaders = members.groupBy("bucket").agg(F.max(F.struct("reach", "content")).alias("leader"))
    pairs = (
        members.join(leaders, "bucket")
        .select(F.col("content").alias("u"), F.col("leader.content").alias("v"))
        .filter("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    wanted = central.select("content").join(
        signed.groupBy("content").agg(F.min(_ordered(_KEY)).alias("first"), F.first("n").alias("n")), "content"
    ).select("content", "n", F.col("first._id").alias("_w_id"), F.col("first._text_hash").alias("_w_hash"))
    texts = materialise(
        source.join(
            wanted, F.col("_id").eqNullSafe(F.col("_w_id")) & (F.col("_text_hash") == F.col("_w_hash"))
        ).select("content", "n", "text").dropDuplicates(["content"]),
        "texts",
    )
    links = materialise(_links(pairs, texts), "links")
    roots = materialise(connected_components(links), "roots")

    # What shares a bucket but not a component may still be linked.
    placed = members.join(roots, members["content"] == roots["node"], "left").select(
        "bucket", "content", F.coalesce("root", "content").alias("root")
    )
    open_ = materialise(_mixed(placed).select("content", "root").distinct(), "open")
    prefixes = _prefixes(texts.join(open_.select("content"), "content", "left_semi"))
    placed = materialise(_mixed(prefixes.join(open_, "content")), "placed")
    rest = _across(placed).join(pairs, ["u", "v"], "left_anti")
    more = materialise(_links(rest, texts), "links")
    if not more.isEmpty():
        roots = materialise(extended(roots, more), "roots")
    keyed = signed.select(*_KEY, "content").distinct()
    labelled = keyed.join(roots, keyed["content"] == roots["node"], "left").select(
        *_KEY, F.coalesce("root", "content").alias("root")
    )
    labelled = materialise(labelled, "labelled")
    named = labelled.groupBy("root").agg(F.min(_ordered(_KEY)).alias("first"), F.count("*").alias("class_size"))
    # The few classes that hold a large share of all documents are broadcast, so no task gets one whole.
    named = materialise(named.withColumn("weight", F.col("class_size")), "classes")
    return join_by_weight(labelled, named, ["root"], "weight").select(
        *_KEY, F.col("first._id").alias("class_id"), F.col("first._text_hash").alias("class_hash"), "class_size"
    )


def _own(found: DataFrame) -> DataFrame:
    return found.select(F.col("_id").alias("_o_id"), F.col("_text_hash").alias("_o_hash"), *found.columns[2:])


def drop_near_copies(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, its first, with its columns as they were."""
    found = _own(classes(documents, id_col, text_col))
    first = found.filter(F.col("_o_id").eqNullSafe(F.col("class_id")) & (F.col("_o_hash") == F.col("class_hash")))
    rows = documents.select(*doc_key(id_col, text_col), F.struct("*").alias("row"))
    kept = rows.join(
        first, F.col("_id").eqNullSafe(F.col("_o_id")) & (F.col("_text_hash") == F.col("_o_hash")), "left_semi"
    )
    return kept.dropDuplicates(_KEY).select("row.*")


def label(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, class_id, class_size``: a row for each input row."""
    found = _own(classes(documents, id_col, text_col))
    rows = documents.select(*doc_key(id_col, text_col))
    return rows.join(
        found, F.col("_id").eqNullSafe(F.col("_o_id")) & (F.col("_text_hash") == F.col("_o_hash"))
    ).select(F.col("_id").alias("id"), "class_id", "class_size")
