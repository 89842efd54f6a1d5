"""Text quality by a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover all of its UTF-8 bytes. Learned filters over eight
consecutive bytes slide over each chunk in steps of two, a rectifier and the maximum over the
chunk give one value per filter, the mean over all chunks of the text enters a logistic unit.
Training goes backwards through the same steps with Adam.

Null and empty texts count as one chunk of padding and get the constant score of padding. Texts of
any length are read whole; equal texts get equal scores. Only the text is looked at, so nulls and
clashing names in other columns do not matter.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cedarlog.llm import text as tx
from cedarlog.llm.common import fresh
from cedarlog.llm.toxicity import training_rows

WIDTH, FILTERS = 8, 16
CHUNK, OVERLAP = 512, 64
#: Labelled documents and bytes of each that fitting takes at most; the choice goes by hash of the id.
MAX_TRAINING_DOCS = 3_000
MAX_TRAINING_BYTES = 65_536
#: Chunks of one document that one pass of the fitting looks at; scoring looks at all.
CHUNKS_PER_PASS = 5
EPOCHS, BATCH, LEARNING_RATE, DECAY = 10, 64, 0.01, 1e-4
THRESHOLD = 0.3
#: Chunks handled at once when scoring.
BLOCK_CHUNKS = 128


@dataclasses.dataclass(frozen=True)
class Model:
    """``filters[j, b, f]``: what byte ``b`` at place ``j`` adds to filter ``f``."""

    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float

    def pairs(self) -> np.ndarray:
        """Tables by two bytes at once: half the look-ups."""
        out = [
            (self.filters[j][None, :, :] + self.filters[j + 1][:, None, :]).reshape(65536, -1)
            for j in range(0, WIDTH, 2)
        ]
        return np.asarray(out, dtype=np.float32)


def _cut(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of every chunk."""
    length = np.diff(bounds)
    step = CHUNK - OVERLAP
    count = np.maximum(1, -(-(length - OVERLAP) // step))
    doc = np.repeat(np.arange(len(length)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = bounds[doc] + nth * step
    return doc, start, np.minimum(start + CHUNK, bounds[doc + 1])


def _load(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    at = start[:, None] + np.arange(CHUNK)
    inside = at < end[:, None]
    if not len(raw):
        return np.zeros(at.shape, np.uint8)
    return np.where(inside, raw[np.minimum(at, len(raw) - 1)], 0).astype(np.uint8)


def _respond(tables: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """Filter sums at every place of every chunk."""
    two = np.ascontiguousarray(chunks).view("<u2")
    places = two.shape[1] - WIDTH // 2 + 1
    out = tables[0][two[:, :places]]
    for j in range(1, WIDTH // 2):
        out += tables[j][two[:, j : j + places]]
    return out


def score_batch(model: Model, tables: np.ndarray, column: pa.Array) -> pa.Array:
    """Probability of good quality for an Arrow column of texts."""
    raw, bounds = tx.text_bytes(column)
    scores = np.zeros(len(column))
    for i, j in tx.blocks(bounds):
        doc, start, end = _cut(bounds[i : j + 1])
        total = np.zeros((j - i, FILTERS))
        for a in range(0, len(doc), BLOCK_CHUNKS):
            part = slice(a, a + BLOCK_CHUNKS)
            top = _respond(tables, _load(raw, start[part], end[part])).max(axis=1)
            np.add.at(total, doc[part], np.maximum(top + model.bias, 0))
        mean = total / np.bincount(doc, minlength=j - i)[:, None]
        scores[i:j] = 1 / (1 + np.exp(-np.clip(mean @ model.weights + model.offset, -50, 50)))
    return pa.array(scores)


def fit(texts: list[str], labels: list[int], seed: int = 5) -> Model:
    """Filters and weights from labelled texts."""
    rng = np.random.default_rng(seed)
    model = Model(
        rng.normal(0, 0.1, (WIDTH, 256, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.3, FILTERS), 0.0
    )
    if not texts or len(set(labels)) < 2:
        sure = 4.0 if any(labels) or not texts else -4.0
        return dataclasses.replace(model, weights=np.zeros(FILTERS), offset=sure)
    raw, bounds = tx.text_bytes(pa.array(texts, pa.string()))
    doc, start, end = _cut(bounds)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    y = np.asarray(labels, float)
    parts = [model.filters, model.bias, model.weights, np.array(model.offset)]
    m, v, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            docs = order[at : at + BATCH]
            some = [
                rng.choice(np.arange(first[d], first[d + 1]), min(CHUNKS_PER_PASS, first[d + 1] - first[d]), replace=False)
                for d in docs
            ]
            owner = np.repeat(np.arange(len(docs)), [len(s) for s in some])
            chosen = np.concatenate(some)
            chunks = _load(raw, start[chosen], end[chosen])
            model = Model(*parts[:3], float(parts[3]))
            sums = _respond(model.pairs(), chunks)
            best = sums.argmax(axis=1)
            f = np.maximum(np.take_along_axis(sums, best[:, None, :], 1)[:, 0, :] + parts[1], 0)
            count = np.bincount(owner, minlength=len(docs))[:, None]
            mean = np.zeros((len(docs), FILTERS))
            np.add.at(mean, owner, f)
            mean /= count
            p = 1 / (1 + np.exp(-np.clip(mean @ parts[2] + parts[3], -50, 50)))
            slope = (p - y[docs]) / len(docs)
            back = np.where(f > 0, (slope[:, None] * parts[2] / count)[owner], 0.0)
            grad = np.zeros_like(parts[0])
            rows, cols = np.arange(len(chosen))[:, None], np.arange(FILTERS)[None, :]
            for j in range(WIDTH):
                np.add.at(grad[j], (chunks[rows, 2 * best + j], np.broadcast_to(cols, best.shape)), back)
            grads = [grad, back.sum(0), mean.T @ slope, slope.sum()]
            step += 1
            for k, g in enumerate(grads):
                g = g + DECAY * parts[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                parts[k] = parts[k] - LEARNING_RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(*parts[:3], float(parts[3]))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAINING_DOCS) -> Model:
    rows = training_rows(documents, labels, "quality", ~held_out(), max_docs, MAX_TRAINING_BYTES)
    return fit([t for t, _ in rows], [y for _, y in rows])


def scorer(documents: DataFrame, model: Model):
    """A column function: text to quality; the model travels to each executor once."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    tables: list = []

    @F.arrow_udf("double")
    def quality(column: pa.Array) -> pa.Array:
        if not tables:
            tables.append(shared.value.pairs())
        return score_batch(shared.value, tables[0], column)

    return quality


def score_documents(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with ``quality``; the name gets underscores in front if it is taken."""
    (name,) = fresh(documents, "quality")
    return documents.withColumn(name, scorer(documents, model)(F.col(text)))


def keep_good(documents: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Documents that score ``threshold`` or more, with their columns as they were."""
    return documents.filter(scorer(documents, model)(F.col(text)) >= threshold)
