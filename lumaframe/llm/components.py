"""Union-find grouping of an edge table: inside each partition first, then by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.scratch import Scratch
from lumaframe.llm.skew import join_counted


def _local_union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links, contracted to one link from each node to the smallest node it reaches there."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    def emptied() -> pa.RecordBatch:
        nodes = list(parent)
        out = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(n) for n in nodes], pa.int64())], names=["u", "v"])
        parent.clear()
        return out

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 500_000:  # a partition of any size is contracted in parts; the stars join the parts
            yield emptied()
    if parent:
        yield emptied()


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame, size: int) -> DataFrame:
    near = _both(edges)
    least = near.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
    joined = join_counted(near, least, ["u"], "n", 2 * size)  # a component's centre may have a third of all links
    return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame, size: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_counted(down, least, ["u"], "n", size).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(u, v) integer links -> (node, component): the smallest node reachable, for every node of a link.

    Links of a node with itself only name the node and are dropped. The
    number of rounds grows with the logarithm of the longest path. Only the
    last round's table stays in ``scratch``.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    stars = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u != v").mapInArrow(_local_union_find, "u long, v long").where("u != v")
    stars = scratch.write(stars.distinct(), "stars")
    before = _mark(stars)
    while before[0]:
        large = scratch.write(_large_star(stars, before[0]), "stars")
        scratch.discard(stars)
        stars = scratch.write(_small_star(large, large.count()), "stars")
        scratch.discard(large)
        after = _mark(stars)
        if after == before:
            break
        before = after
    grown = stars.groupBy("u").agg(F.min("v").alias("v"))
    return grown.select(F.col("u").alias("node"), F.col("v").alias("component"))
