"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _seen(up: dict[int, int], node: int) -> int:
    up.setdefault(node, node)
    return node


def _by_hand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges, in one task."""
    up: dict[int, int] = {}

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = top(_seen(up, a)), top(_seen(up, b))
            up[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([top(i) for i in up], pa.int64())], names=["node", "root"])


def components(edges: DataFrame, one_task: int = 0) -> DataFrame:
    """(node, root) for every node of edges (a, b), both long; root is the smallest node of the component.

    Minima are pre-aggregated before each shuffle and joined back, so a node with many links is no single row. Up to
    one_task edges are done by one task instead of rounds of joins.
    """
    if one_task:
        edges = edges.where("a <> b").distinct().persist()
        if edges.count() <= one_task:
            return edges.select("a", "b").coalesce(1).mapInArrow(_by_hand, "node long, root long")
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: neighbours above a node go to its smallest neighbour
        up = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        up = materialize(up, "large-star")
        # small star: neighbours below a node, and the node, go to the smallest of them
        low = up.groupBy("a").agg(F.min("b").alias("m"))
        down = up.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        old, now = now, materialize(down, "small-star")
        discard(old, up)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    nodes = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return nodes.union(nodes.select(F.col("root").alias("node"), "root").distinct())
