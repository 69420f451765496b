"""Ordered trees as rows, and a form of them in which names and literals don't show.

A tree is rows of (tree, node, parent, place, kind, name): its root has no
parent, ``place`` orders siblings, ``kind`` is what a node is, and ``name`` what
an identifier is called.  Literals come without their value.  Passes go up and
down one depth at a time, so a round is one join however many trees there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import staged


def _by_depth(nodes: DataFrame) -> list[DataFrame]:
    """The nodes that a root leads to, depth by depth; nodes without a way from a root are in no tree."""
    levels = [staged(nodes.where("parent is null"))]
    rest = staged(nodes.where("parent is not null"))
    while True:
        above = levels[-1].select("tree", F.col("node").alias("parent"))
        below = staged(rest.join(above, ["tree", "parent"], "left_semi").select(nodes.columns))
        if below.isEmpty():
            return levels
        levels.append(below)


def canonical(nodes: DataFrame) -> DataFrame:
    """tree, digest, nodes: the form of each tree, equal for trees that differ in names and literals alone, and its size.

    A name counts as the place in the tree, in preorder, where it stands first,
    so trees meet if one is the other with names exchanged one for one.  Sizes
    go up, places go down, and digests of a node with its children in order go
    up again.  Names of inner nodes count like those of leaves.  A node id that
    repeats in a tree, or siblings of one place, are taken in the order of
    their ids.
    """
    levels = _by_depth(nodes.select("tree", F.col("node").cast("string").alias("node"), F.col("parent").cast("string").alias("parent"), "place", "kind", "name"))
    sized: list[DataFrame] = []
    for level in reversed(levels):
        if sized:
            inner = sized[-1].groupBy("tree", F.col("parent").alias("node")).agg(F.sum("size").alias("_s"))
            level = level.join(inner, ["tree", "node"], "left")
        else:
            level = level.withColumn("_s", F.lit(None).cast("bigint"))
        sized.append(staged(level.withColumn("size", 1 + F.coalesce("_s", F.lit(0))).drop("_s")))
    sized.reverse()
    placed: list[DataFrame] = []
    before = Window.partitionBy("tree", "parent").orderBy("place", "node").rowsBetween(Window.unboundedPreceding, -1)
    for level in sized:
        level = level.withColumn("_b", F.coalesce(F.sum("size").over(before), F.lit(0)))
        if placed:
            level = level.join(placed[-1].select("tree", F.col("node").alias("parent"), F.col("at").alias("_p")), ["tree", "parent"])
            level = level.withColumn("at", F.col("_p") + 1 + F.col("_b")).drop("_p")
        else:
            level = level.withColumn("at", F.col("_b"))
        placed.append(staged(level.drop("_b")))
    first = reduce(DataFrame.unionByName, placed).where("name is not null").groupBy("tree", "name").agg(F.min("at").alias("_first"))
    first = staged(first)
    digests = None
    for level in reversed(placed):
        level = level.join(first, ["tree", "name"], "left")
        if digests is not None:
            # A node's own children, in order; their digests are of one length.
            inner = digests.groupBy("tree", F.col("parent").alias("node")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]), "").alias("_inner"))
            level = level.join(inner, ["tree", "node"], "left")
        else:
            level = level.withColumn("_inner", F.lit(None).cast("string"))
        own = F.to_json(F.struct(F.col("kind").alias("k"), F.col("_first").alias("n"), F.col("_inner").alias("c")))
        digests = staged(level.select("tree", "parent", "at", "size", F.sha2(own, 256).alias("digest")))
    return digests.groupBy("tree").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]), "").alias("digest"), F.sum("size").alias("nodes"))


def copies(forms: DataFrame, least: int = 0) -> DataFrame:
    """tree, value, nodes: for each tree how many others have its form; trees of fewer than ``least`` nodes are left out."""
    held = forms.where(F.col("nodes") >= least)
    sizes = held.groupBy(F.col("digest").alias("_d")).agg((F.count(F.lit(1)) - 1).alias("value"))
    return held.join(sizes, F.col("digest") == F.col("_d")).select("tree", "value", "nodes")
