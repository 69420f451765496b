"""Connected components of links that stay distributed: stars that grow towards each component's least node."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import drop, stage

EDGES = "u bigint, v bigint"


#: Links that one task may hold; more of them are joined by rounds of stars first.
HERE = 1 << 20


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links in ascending order, and for each the place of the least one it reaches."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if (root == before).all():
            return nodes, root


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each batch as stars around the least node; a batch is bounded, so is this."""
    for batch in batches:
        nodes, root = _roots(*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)))
        far = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], names=["u", "v"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links, HERE at most, as every node with the least one it reaches."""
    held = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(2)] for b in batches if b.num_rows]
    if held:
        nodes, root = _roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step.  Each node's least neighbour comes from a map-side combined minimum, so a hub's neighbours never gather in one place."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("_u"), F.least("_u", "least").alias("least"))
    met = both.join(least, F.col("u") == F.col("_u"))
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select(F.col("_u").alias("u"), F.col("least").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component: every node of ``links`` (two bigint columns) with the least node it reaches.

    Alternates large-star and small-star steps until the edges stand still;
    the rounds grow with the logarithm of the longest chain.  Where each
    batch's forest leaves HERE links or fewer, one task joins them instead, as
    a round of many small tasks would cost more than its work.  Links that
    repeat, that go both ways or join a node to itself are harmless; no links
    give an empty table.
    """
    a, b = links.columns
    edges = links.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).where("u <> v")
    edges = stage(edges.mapInArrow(_forest, EDGES), "forests")
    if edges.count() <= HERE:
        return stage(edges.coalesce(1).mapInArrow(_finish, "node bigint, component bigint"), "components")
    edges = stage(edges.distinct(), "stars")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()  # noqa: E731  two numbers
    seen = mark(edges)
    while True:
        after = stage(_star(_star(edges, True), False), "stars")
        drop(edges)
        edges, now = after, mark(after)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("u"), "v").distinct()
    return edges.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
