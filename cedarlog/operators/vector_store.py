"""A vector store that reads only the cells a query can need; results stay exact.

Documents lie in cells by their nearest centroid. A cell knows its radius: the largest angle between its
centroid and one of its vectors. Angles keep the triangle inequality, so no vector of a cell is nearer to a query
than the angle to the centroid less the radius. A search opens the nearest cells that hold ``k`` documents, which
bounds the k-th best similarity, and then only cells whose bound reaches that far.

Queries stay in a DataFrame; the centroids, at most ``MAX_CELLS``, travel to the tasks. Cells are stored in parts of
at most about ``PART`` vectors by hash of the id, and a task compares one part with a block of at most about ``QUERIES``
queries that ask for it, so neither a cell with a third of all documents nor a favourite cell lands in one task.
Parts and blocks are as large as memory allows, because each part travels once for every block and the reverse.

Where bounds cut nothing off, asking with every vector is quadratic by nature, so a pair must be cheap: products are in
single precision, and only pairs that can reach the k-th similarity, the error of that precision considered, are computed
again in double precision and ordered. The second round starts from the k-th similarity of the first.
Vectors of length 0 are similar to nothing (0) and have a cell of their own; vectors that are null are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cedarlog.operators.joins import broadcast_if_small
from cedarlog.session import materialise

MAX_CELLS = 4096
#: Vectors that placing the centroids looks at; where they lie changes the speed, not the result.
SAMPLE = 100_000
#: Vectors of a part and queries of a block, less where they hold more than ``VALUES`` numbers.
PART = 65_536
QUERIES = 16_384
VALUES = 1 << 22
#: Multiplications that are worth a task, and tasks of a round at most.
WORK = 1 << 28
MAX_TASKS = 4_000
#: Queries and vectors of one matrix product; with more than one hit in ``SPARSE`` pairs, all are computed again.
ROWS, COLUMNS, SPARSE = 256, 4_096, 64
NO_CELL = -1
#: Room for rounding when bounds are compared.
ROOM = 2e-6


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    widths = pc.min_max(pc.list_value_length(column))
    if widths["min"] != widths["max"]:
        raise ValueError(f"vectors of {widths['min']} and of {widths['max']} numbers")
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return values.reshape(len(column), widths["min"].as_py())


def _at_most(rows: int, width: int) -> int:
    return max(1, min(rows, VALUES // max(width, 1)))


def _angles(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ centroids.T, -1.0, 1.0))


def place_centroids(docs: DataFrame, cells: int, seed: int = 11) -> np.ndarray:
    """Unit centroids from a sample of at most about ``SAMPLE`` vectors."""
    n = docs.count()
    some = docs if n <= SAMPLE else docs.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * SAMPLE / n))
    few = some.select("embedding").distinct().limit(2).collect()
    if len(few) < 2:  # k-means needs two different points
        return _unit(np.array([r["embedding"] for r in few], dtype=np.float64))
    rows = some.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model = KMeans(k=max(2, min(cells, MAX_CELLS, max(n, 2))), seed=seed, maxIter=8, featuresCol="v", distanceMeasure="euclidean").fit(rows)
    centers = _unit(np.array(model.clusterCenters()))
    return centers[np.linalg.norm(centers, axis=1) > 0]


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            cell, angle = np.zeros(0, np.int32), np.zeros(0)
            if len(batch):
                v = _unit(_matrix(batch["embedding"]))
                empty = ~v.any(axis=1)
                angles = _angles(v, centroids) if len(centroids) else np.zeros((len(v), 1))
                cell = angles.argmin(axis=1).astype(np.int32)
                angle = angles[np.arange(len(v)), cell]
                cell[empty if len(centroids) else slice(None)] = NO_CELL
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], [*batch.schema.names, "cell", "angle"])

    return run


def write_store(docs: DataFrame, path: str, cells: int = 256, id_col: str = "id") -> None:
    """Write ``docs`` (``id``, ``embedding`` and any other columns) as a store at ``path``."""
    rows = docs.withColumnRenamed(id_col, "id").filter(F.col("embedding").isNotNull())
    # Rows without direction tell nothing about where centroids should lie.
    some = F.exists("embedding", lambda x: x != 0)
    centroids = place_centroids(rows.filter(some), cells) if not rows.filter(some).isEmpty() else np.zeros((0, 0))
    shape = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    placed = materialise(rows.mapInArrow(_assign(centroids), shape), "placed")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    spark = docs.sparkSession
    centers = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    sizes.join(centers, "cell", "left").write.mode("overwrite").parquet(f"{path}/cells")
    size = _at_most(PART, centroids.shape[1])
    known = broadcast_if_small(sizes.select("cell", "n"))
    parts = placed.join(known, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / size)).cast("int")).drop("n", "angle")
    parts.limit(0).write.mode("overwrite").parquet(f"{path}/shape")
    parts.repartition("cell", "part").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("cell").parquet(f"{path}/vectors")


def _wanted(cells: list, k: int, rest: bool):
    """Adds to each query its nearest ``cells``, which hold ``k`` documents, or with ``rest`` the others that can reach ``least``."""
    number = np.array([c["cell"] for c in cells], np.int32)
    radius = np.array([c["radius"] for c in cells])
    size = np.array([c["n"] for c in cells], np.int64)
    none = number == NO_CELL
    width = _width(cells)
    centroids = np.array([c["centroid"] or [0.0] * width for c in cells]).reshape(len(cells), width)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if not len(batch):
                continue
            v = _unit(_matrix(batch["v"]))
            angles = _angles(v, centroids) if width else np.zeros((len(v), len(cells)))
            order = np.argsort(angles, axis=1, kind="stable")
            before = np.cumsum(size[order], axis=1) - size[order]
            opened = np.empty(order.shape, bool)
            np.put_along_axis(opened, order, before < k, axis=1)
            if rest:
                best = np.cos(np.maximum(angles - radius, 0.0)) if width else np.zeros(angles.shape)
                best[:, none] = 0.0
                best[~v.any(axis=1)] = 0.0
                least = _bound(batch["least"])[:, None]
                opened = ~opened & ~(best + ROOM < least)  # a bound that is no number cuts nothing off
            ends = np.append(0, np.cumsum(opened.sum(axis=1))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(number[np.nonzero(opened)[1]]))
            columns = ["query_id", "v", "least"]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in columns], lists], [*columns, "cells"])

    return run


def _width(cells: list) -> int:
    return max((len(c["centroid"]) for c in cells if c["centroid"]), default=0)


def _bound(least: pa.Array) -> np.ndarray:
    return least.fill_null(-np.inf).to_numpy(zero_copy_only=False)


def _best(of: np.ndarray, at: np.ndarray, sims: np.ndarray, k: int):
    """The ``k`` best places of each query, equal ones by place; a place counts once. Also which rows are a ``k``-th."""
    order = np.lexsort((-sims, at, of))
    of, at, sims = of[order], at[order], sims[order]
    once = np.append(True, (of[1:] != of[:-1]) | (at[1:] != at[:-1]))[: len(of)]
    of, at, sims = of[once], at[once], sims[once]
    order = np.lexsort((at, -sims, of))
    of, at, sims = of[order], at[order], sims[order]
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
    rank = np.arange(len(of)) - np.repeat(starts, np.diff(np.append(starts, len(of))))
    kept = rank < k
    return of[kept], at[kept], sims[kept], rank[kept] == k - 1


def _best_of_all(sims: np.ndarray, k: int) -> np.ndarray:
    """Where the ``k`` best of each row stand, of equal ones the first."""
    if sims.shape[1] <= k:
        return np.ones(sims.shape, bool)
    last = np.partition(sims, -k, axis=1)[:, [-k]]
    above, equal = sims > last, sims == last
    return above | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= k - above.sum(axis=1, keepdims=True)))


def _nearest(asked: np.ndarray, docs: np.ndarray, place: np.ndarray, least: np.ndarray, k: int):
    """For unit vectors: rows of ``asked``, places and similarities of the best ``k`` that are not under ``least``.

    ``place`` numbers the ids of ``docs`` and ascends, so rows of one id stand together.
    """
    few, many = asked.astype(np.float32), docs.astype(np.float32)
    # Twice the error of a product in single precision, and what rounding adds.
    room = (docs.shape[1] + 8) * 2.0**-23 + 1e-6
    out = []
    for a in range(0, len(asked), ROWS):
        rows, low = asked[a : a + ROWS], least[a : a + ROWS].copy()
        found: list[tuple] = []

        def merge():
            of, at, sims, last = _best(*(np.concatenate(x) for x in zip(*found, strict=True)), k)
            found[:] = [(of, at, sims)]
            low[of[last]] = np.maximum(low[of[last]], sims[last])
            # What follows has larger ids, so it cannot come before k of similarity 1.
            low[of[last & (sims >= 1.0)]] = np.inf

        for c in range(0, len(docs), COLUMNS):
            held, names = docs[c : c + COLUMNS], place[c : c + COLUMNS]
            hits = few[a : a + ROWS] @ many[c : c + COLUMNS].T >= (low - room).astype(np.float32)[:, None]
            n = np.count_nonzero(hits)
            if n * SPARSE > hits.size:
                sims = np.round(rows @ held.T, 6) + 0.0
                starts = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
                if len(starts) < len(names):
                    sims, names = np.maximum.reduceat(sims, starts, axis=1), names[starts]
                of, at = np.nonzero(_best_of_all(sims, k) & (sims >= low[:, None]))
                found.append((of, names[at], sims[of, at]))
                merge()
            elif n:
                of, at = np.divmod(np.flatnonzero(hits), hits.shape[1])
                sims = np.round(np.einsum("ij,ij->i", rows[of], held[at]), 6) + 0.0
                fit = sims >= low[of]
                found.append((of[fit], names[at[fit]], sims[fit]))
                if sum(len(x[0]) for x in found) > 4 * k * ROWS:
                    merge()
        if found:
            merge()
            of, at, sims = found[0]
            out.append((of + a, at, sims))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _compare(k: int, id_type: pa.DataType, q_type: pa.DataType):
    """Arrow function: the best ``k`` ids of a part for each of some queries, equal ones by id; an id counts once."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        names, ids = asked["query_id"], held["id"]
        of, at, sims = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        if len(asked) and len(held):
            order = pc.sort_indices(ids)
            ids = ids.take(order)
            new = pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), True).to_numpy()
            starts = np.flatnonzero(np.append(True, new))
            place = np.append(0, np.cumsum(new))
            docs = _unit(_matrix(held["embedding"].combine_chunks()))[order.to_numpy()]
            least = _bound(asked["least"].combine_chunks())
            of, at, sims = _nearest(_unit(_matrix(asked["v"].combine_chunks())), docs, place, least, k)
            at = starts[at]
        return pa.table({
            "query_id": names.take(pa.array(of, pa.int64())).cast(q_type), "id": ids.take(pa.array(at, pa.int64())).cast(id_type),
            "similarity": pa.array(sims, pa.float64()),
        })

    return run


def _meet(store: DataFrame, asked: DataFrame, cells: list, k: int) -> DataFrame:
    """The best ``k`` of each query (``query_id, v, least, cells``) among its cells, as far as they reach ``least``."""
    pairs = asked.withColumn("cell", F.explode("cells")).drop("cells")
    wanted = {r["cell"]: r["n"] for r in pairs.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most MAX_CELLS
    width, size = _width(cells), {c["cell"]: c["n"] for c in cells}
    blocks = {c: -(-n // _at_most(QUERIES, width)) for c, n in wanted.items()}
    groups = sum(n * -(-size[c] // _at_most(PART, width)) for c, n in blocks.items())
    work = sum(n * size[c] * max(width, 1) for c, n in wanted.items())
    tasks = max(1, min(groups, MAX_TASKS, work // WORK + 1))
    split = F.broadcast(store.sparkSession.createDataFrame(list(blocks.items()), "cell int, blocks int"))
    docs = store.filter(F.col("cell").isin(list(wanted))).select("id", "embedding", "cell", "part")
    parts = broadcast_if_small(docs.select("cell", "part").distinct())
    # Of equal vectors only the k smallest ids can be among the best.
    equal = Window.partitionBy("embedding").orderBy("id")
    few = docs.withColumn("n", F.dense_rank().over(equal)).filter(F.col("n") <= k).drop("n")
    block = F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")
    dealt = pairs.join(split, "cell").withColumn("block", block).drop("blocks").join(parts, "cell")
    held = few.join(split, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    keys = ["cell", "part", "block"]
    own = [f"_{c}" for c in keys]
    held = held.withColumnsRenamed(dict(zip(keys, own, strict=True)))
    id_type, q_type = docs.schema["id"].dataType, asked.schema["query_id"].dataType
    shape = f"query_id {q_type.simpleString()}, id {id_type.simpleString()}, similarity double"
    return dealt.repartition(tasks, *keys).groupBy(*keys).cogroup(held.repartition(tasks, *own).groupBy(*own)).applyInArrow(
        _compare(k, to_arrow_type(id_type), to_arrow_type(q_type)), shape
    )


def _rank(found: DataFrame, k: int) -> DataFrame:
    once = found.repartition("query_id").groupBy("query_id", "id").agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 2, where: Column | None = None,
           query_id: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """``query_id, id, similarity, rank`` as :func:`top_k` finds them over all vectors, and the cells each query opened.

    ``where`` is a condition on the other columns of the store. The second table has ``query_id, opened, cells``.
    """
    cells = spark.read.parquet(f"{path}/cells").collect()  # at most MAX_CELLS rows
    store = spark.read.schema(spark.read.parquet(f"{path}/shape").schema).parquet(f"{path}/vectors")
    store = store if where is None else store.filter(where)
    v = F.col("embedding") if queries.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else F.col("embedding").cast("array<double>")
    asked = queries.select(F.col(query_id).alias("query_id"), v.alias("v"), F.lit(None).cast("double").alias("least"))
    asked = asked.filter(F.col("v").isNotNull())
    shape = T.StructType([*asked.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])
    first = materialise(asked.mapInArrow(_wanted(cells, k, rest=False), shape), "first")
    near = materialise(_meet(store, first, cells, k), "nearest")
    # With fewer than k found nothing is bounded.
    least = _rank(near, k).groupBy("query_id").agg(F.count("*").alias("found"), F.min("similarity").alias("least"))
    bounded = least.filter(F.col("found") >= k).drop("found")
    known = first.drop("least", "cells").join(bounded, "query_id", "left")
    rest = materialise(known.mapInArrow(_wanted(cells, k, rest=True), shape), "rest")
    found = _rank(near.unionByName(_meet(store, rest, cells, k)), k)
    opened = first.unionByName(rest).groupBy("query_id").agg(F.sum(F.size("cells")).alias("opened")).withColumn(
        "cells", F.lit(len(cells)).cast("bigint")
    )
    return found, opened
