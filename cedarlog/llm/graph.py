"""Connected components of a graph that no machine can hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cedarlog.llm.common import materialise


def _written(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """``edges`` written, and what tells whether they changed, taken while writing."""
    seen = Observation()
    kept = materialise(
        edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), name
    )
    return kept, tuple(seen.get.values())


def _min_neighbour(directed: DataFrame) -> DataFrame:
    return directed.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``u, v``): the smallest node it is linked with.

    Large-star and small-star in turn until nothing changes, each a minimum per node and a join. No
    component is ever in one place; a node with very many neighbours is split by adaptive execution.
    Null ends and loops are left out.
    """
    now, before = _written(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_min_neighbour(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.filter("u <> v"), "large-star")
        least = _min_neighbour(large)
        small = (
            large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        now, after = _written(small, "small-star")
        if after == before:
            break
        before = after
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def extended(roots: DataFrame, more: DataFrame) -> DataFrame:
    """``node, root`` after the edges ``more`` were added to the graph that ``roots`` came from.

    Only the components that ``more`` links are looked at: they are the nodes of a smaller graph.
    """
    known = roots.select(F.col("node").alias("u"), F.col("root").alias("a"))
    ends = more.join(known, "u", "left").select("v", F.coalesce("a", "u").alias("a"))
    ends = ends.join(known.select(F.col("u").alias("v"), F.col("a").alias("b")), "v", "left")
    linked = materialise(connected_components(ends.select(F.col("a").alias("u"), F.coalesce("b", "v").alias("v"))), "linked")
    moved = linked.select(F.col("node").alias("root"), F.col("root").alias("now"))
    old = roots.join(moved, "root", "left").select("node", F.coalesce("now", "root").alias("root"))
    # Nodes that had no edge before are among the linked ones.
    new = linked.join(roots, "node", "left_anti")
    return old.unionByName(new.select("node", "root"))
