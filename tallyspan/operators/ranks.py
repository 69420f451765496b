"""Places of rows within their key, where one key may hold most of the rows.

A window over a key sorts all of its rows in one task.  Here the rows are dealt
by ranges of (key, order) instead, so that a hot key is cut into many ranges; a
row's place is its place in its range and the rows of its key in ranges before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import staged


def ranked(rows: DataFrame, keys: list[str], order: list[Column], rank: str = "rn", total: str | None = None) -> DataFrame:
    """Rows with their place (from 1) within ``keys`` in the order given, and if named the key's ``total`` of rows.

    Null keys are a key of their own, and nulls come first in an ascending
    order, as in a window.  Rows that tie in the order are told apart by a hash
    of all their columns; rows equal in everything may take each other's place,
    and they alone share a task however many they are.
    """
    tied = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    dealt = rows.withColumn("_tie", tied).repartitionByRange(*[F.col(k) for k in keys], *order, "_tie")
    dealt = staged(dealt.withColumn("_range", F.spark_partition_id()))
    held = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range of a key
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    held = held.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_at"), "_before", "_all")
    here = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order, "_tie"))
    same = F.col("_range") == F.col("_at")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    placed = dealt.withColumn("_here", here).join(held, same)
    extra = [F.col("_all").alias(total)] if total else []
    return placed.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_here") + F.col("_before")).alias(rank), *extra)
