"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence that holds weighted words gets a probability from their
sum and a learned bias, any other sentence none, and the document's probability is their noisy-or:
one minus the chance that no sentence is toxic. Only documents carry labels, yet the fitted sentence
scores locate the offending ones. Weights go to words and beginnings of words that labelled toxic documents
hold far more often than the others do (chi-squared), so that chance words of long documents do not add up.

Sentences end at ``.``, ``!``, ``?`` or a line end; words are runs of ASCII letters, digits and
characters beyond ASCII, with A-Z lower-cased. Null and empty texts have no sentence and score 0.
Repeated rows get equal scores; no column but the text is looked at, so nulls and extra columns
elsewhere do not matter. An empty table gives an empty result; without labels, or with none that is toxic, every
text scores 0, with only toxic labels every text scores 1.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cedarlog.llm import text as tx
from cedarlog.llm.common import fresh, materialise

#: Bits of the table of word weights.
BITS = 18
#: A word is also known by its first bytes, so that new forms of a word are recognised.
PREFIXES = (3, 4)
#: Labelled documents and bytes of each that fitting takes at most; the choice goes by hash of the id.
MAX_TRAINING_DOCS = 6_000
MAX_TRAINING_BYTES = 65_536
#: Features found in fewer toxic training documents get no weight, nor those whose chi-squared value is
#: smaller than this, or than this share of the number of training documents.
MIN_DOCS = 5
MIN_CHI2, MIN_EFFECT = 15.0, 1 / 60
EPOCHS = 200
LEARNING_RATE = 0.1
L2 = 1e-5
START_BIAS = -3.0
THRESHOLD = 0.3

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?\n\r"]] = True
RESULT = "struct<score:double,sentences:array<struct<start:int,length:int,score:double>>>"


@dataclasses.dataclass(frozen=True)
class Model:
    """``weights`` by word bucket, the bias that every sentence starts from, and the least score of any text."""

    weights: np.ndarray
    bias: float
    least: float = 0.0


def _sentences(raw: np.ndarray, bounds: np.ndarray):
    """Feature buckets, the first one of each sentence, sentence spans, and the first sentence of each text."""
    first, last = tx.runs(~_BREAK[raw], bounds)
    starts, ends = tx.runs(tx.ALNUM[raw], bounds)
    codes = tx.lower_codes()
    hashes = np.stack(
        [tx.hash_runs(raw, starts, ends, codes)]
        + [tx.mix(tx.hash_runs(raw, starts, np.minimum(ends, starts + n), codes) ^ np.uint64(n)) for n in PREFIXES],
        axis=1,
    )
    bucket = (hashes >> np.uint64(64 - BITS)).astype(np.int64).ravel()
    word_from = np.searchsorted(starts, first)
    word_to = np.searchsorted(starts, last)
    full = word_to > word_from
    return bucket, word_from[full] * hashes.shape[1], first[full], last[full], np.searchsorted(first[full], bounds)


def _z(model: Model, bucket: np.ndarray, word_from: np.ndarray) -> np.ndarray:
    if not len(word_from):
        return np.zeros(0)
    held = model.weights[bucket]
    z = np.add.reduceat(held, word_from) + model.bias
    z[~np.logical_or.reduceat(held != 0, word_from)] = -np.inf
    return z


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0.0, -z))


def _features(column: pa.Array):
    """Bucket, sentence and document of every feature of an Arrow column of texts."""
    raw, bounds = tx.text_bytes(column)
    bucket, word_from, _, _, cut = _sentences(raw, bounds)
    if not len(word_from):
        return (np.zeros(0, np.int64),) * 3
    sentence = np.repeat(np.arange(len(word_from)), np.diff(np.append(word_from, len(bucket))))
    return bucket[word_from[0] :], sentence, np.repeat(np.arange(len(cut) - 1), np.diff(cut))[sentence]


def _held(column: pa.Array, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each bucket of the texts, and how many toxic and how many other ones hold it."""
    bucket, _, doc = _features(column)
    pair = np.unique(doc << BITS | bucket)
    word, toxic = pair & ((1 << BITS) - 1), y[pair >> BITS] > 0
    found, at = np.unique(word, return_inverse=True)
    return found, np.bincount(at, toxic, len(found)).astype(np.int64), np.bincount(at, ~toxic, len(found)).astype(np.int64)


def _count(batches):
    for batch in batches:
        parts = _held(batch.column(0), batch.column(1).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(p) for p in parts], ["bucket", "a", "c"])


def _telling(counted: DataFrame, toxic: int, other: int) -> np.ndarray:
    """Buckets that toxic documents hold far more often than others."""
    pos, neg = float(max(toxic, 1)), float(max(other, 1))
    a, c = F.col("a").cast("double"), F.col("c").cast("double")
    chi2 = (pos + neg) * F.pow(a * (neg - c) - (pos - a) * c, 2) / F.greatest(pos * neg * (a + c) * (pos + neg - a - c), F.lit(1.0))
    least = max(MIN_CHI2, MIN_EFFECT * (toxic + other))
    found = counted.filter((a >= MIN_DOCS) & (a * neg > c * pos) & (chi2 >= least)).select("bucket").collect()
    return np.sort(np.array([r["bucket"] for r in found], dtype=np.int64))


def _known_rows(known: np.ndarray):
    """Of each document the telling features, by sentence."""

    def run(batches):
        for batch in batches:
            bucket, sentence, doc = _features(batch.column(0))
            at = np.minimum(np.searchsorted(known, bucket), len(known) - 1)
            keep = known[at] == bucket
            at, sentence, doc = at[keep], sentence[keep], doc[keep]
            yield pa.RecordBatch.from_arrays(
                [batch.column(2).take(pa.array(doc)), batch.column(1).take(pa.array(doc)), pa.array(sentence), pa.array(at)],
                ["doc_id", "y", "sentence", "at"],
            )

    return run


def score_batch(model: Model, column: pa.Array, locate: float | None = None) -> pa.Array:
    """Scores of an Arrow column of texts; with ``locate``, the sentences of at least that probability."""
    raw, bounds = tx.text_bytes(column)
    scores, found = np.zeros(len(column)), []
    for i, j in tx.blocks(bounds):
        a, b = bounds[i], bounds[j]
        bucket, word_from, first, last, cut = _sentences(raw[a:b], bounds[i : j + 1] - a)
        z = _z(model, bucket, word_from)
        total = np.concatenate([[0.0], np.cumsum(_softplus(z))])
        scores[i:j] = np.maximum(-np.expm1(-np.maximum(total[cut[1:]] - total[cut[:-1]], 0.0)), model.least)
        if locate is not None:
            p = _sigmoid(z)
            for d in range(i, j):
                own = np.arange(cut[d - i], cut[d - i + 1])
                hits = own[p[own] >= locate]
                found.append(
                    [
                        {"start": int(first[h] + a - bounds[d]), "length": int(last[h] - first[h]), "score": float(p[h])}
                        for h in hits
                    ]
                )
    if locate is None:
        return pa.array(scores)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())]))
    return pa.StructArray.from_arrays([pa.array(scores), pa.array(found, kind)], ["score", "sentences"])


def _descend(cols: np.ndarray, sentence: np.ndarray, doc: np.ndarray, y: np.ndarray, size: int, docs: int) -> tuple[np.ndarray, float]:
    """Weights of ``size`` features and the bias, by gradient steps on the noisy-or likelihood of ``docs`` documents.

    A row is a feature of a sentence of a document; ``y`` by document. Documents without a row add nothing.
    """
    _, first, rows = np.unique(sentence, return_index=True, return_inverse=True)
    owner, n = doc[first], len(first)
    w, bias = np.zeros(size), START_BIAS
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, EPOCHS + 1):
        z = np.bincount(rows, w[cols], minlength=n) + bias
        mass = np.bincount(owner, _softplus(z), minlength=len(y))
        slope = np.where(y > 0, -1 / np.expm1(np.clip(mass, 1e-3, 50)), 1.0) / docs
        g = slope[owner] * _sigmoid(z)
        grad = np.append(np.bincount(cols, g[rows], minlength=size) + L2 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = LEARNING_RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def fit(sample: DataFrame) -> Model:
    """A model from ``text, y, doc_id`` with one row a document.

    Tasks read the texts: first for the number of documents that hold each feature, then for the sentences that
    hold a telling one. Only those features come to the driver.
    """
    sizes = sample.agg(F.count("*").alias("n"), F.sum("y").alias("toxic")).first()
    n, toxic = sizes["n"], sizes["toxic"] or 0
    nothing = np.zeros(1 << BITS)
    if toxic == n:
        return Model(nothing, START_BIAS, 1.0 if n else 0.0)
    if not toxic:
        return Model(nothing, -30.0)
    counted = sample.select("text", "y").mapInArrow(_count, "bucket long, a long, c long")
    known = _telling(counted.groupBy("bucket").agg(F.sum("a").alias("a"), F.sum("c").alias("c")), toxic, n - toxic)
    if not len(known):
        return Model(nothing, START_BIAS)
    shape = f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, y int, sentence long, at long"
    found = sample.select("text", "y", "doc_id").mapInArrow(_known_rows(known), shape).toPandas()
    found = found.sort_values(["doc_id", "sentence", "at"])
    doc = found["doc_id"].factorize()[0]
    y = found["y"].to_numpy()[np.unique(doc, return_index=True)[1]].astype(float)
    # Sentences count on from document to document.
    place = (doc.astype(np.int64) << 32) + found["sentence"].to_numpy()
    w, bias = _descend(found["at"].to_numpy(), place, doc, y, len(known), n)
    weights = nothing.copy()
    weights[known] = w
    return Model(weights, bias)


def training_sample(documents: DataFrame, labels: DataFrame, label: str, usable: Column, max_docs: int,
                    max_bytes: int) -> DataFrame:
    """``doc_id, text, y``: at most ``max_docs`` labelled texts of at most ``max_bytes`` bytes, the same ones on each run.

    ``usable`` says which ids may be learned from. Ids without a label, null ids and null texts are
    left out; of repeated labels the largest counts, of repeated ids the smallest text.
    """
    marked = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    texts = documents.filter(F.octet_length("text") <= max_bytes).select("doc_id", "text")
    few = marked.orderBy(F.xxhash64("doc_id", F.lit("fit")), "doc_id").limit(2 * max_docs)
    return (
        texts.join(F.broadcast(few), "doc_id")
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id", F.lit("fit")), "doc_id")
        .limit(max_docs)
    )


def training_rows(documents: DataFrame, labels: DataFrame, label: str, usable: Column, max_docs: int,
                  max_bytes: int) -> list:
    """Texts and labels of :func:`training_sample`, for a model that is fitted on the driver."""
    return [(r["text"], r["y"]) for r in training_sample(documents, labels, label, usable, max_docs, max_bytes).collect()]


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAINING_DOCS) -> Model:
    sample = training_sample(documents, labels, "toxic", ~held_out(), max_docs, MAX_TRAINING_BYTES)
    # Read more than once; spread over tasks, as the limit leaves it in one.
    spread = sample.repartition(documents.sparkSession.sparkContext.defaultParallelism, "doc_id")
    return fit(materialise(spread, "toxicity-sample"))


def scorer(documents: DataFrame, model: Model):
    """A column function: text to toxicity; the model travels to each executor once."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def toxicity(column: pa.Array) -> pa.Array:
        return score_batch(shared.value, column)

    return toxicity


def score_documents(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with ``toxicity``; the name gets underscores in front if it is taken."""
    (name,) = fresh(documents, "toxicity")
    return documents.withColumn(name, scorer(documents, model)(F.col(text)))


def locate(documents: DataFrame, model: Model, at_least: float = 0.5, text: str = "text") -> DataFrame:
    """The documents with ``toxic_parts``: spans in UTF-8 bytes and score of each offending sentence."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def parts(column: pa.Array) -> pa.Array:
        return score_batch(shared.value, column, at_least)

    (name,) = fresh(documents, "toxic_parts")
    return documents.withColumn(name, parts(F.col(text))["sentences"])


def drop_toxic(documents: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Documents that score below ``threshold``, with their columns as they were."""
    return documents.filter(scorer(documents, model)(F.col(text)) < threshold)
