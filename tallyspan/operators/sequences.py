"""Lines, runs, spans and other sequences.

Windows are partitioned by the sequence they order (a file, a document, a run),
never by nothing.  Work that stays inside one text is done inside its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked


def split_lines(text: Column) -> Column:
    """Lines for scans: a last line end starts no further line, and a carriage return before a line end is dropped."""
    body = F.regexp_replace(text, r"\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, r"\r\z", "")))


def count_lines(text: Column) -> Column:
    """Line ends of a text."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def lines(df: DataFrame, key: str, text: str, scan: bool = True) -> DataFrame:
    """key, line (from 1), text: one row per line."""
    parts = split_lines(F.col(text)) if scan else F.split(F.col(text), "\n")
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(parts).alias("p", "text")).select(key, (F.col("p") + 1).alias("line"), "text")


def islands(rows: DataFrame, key: str, order: str, member: Column, kind: Column | None = None) -> DataFrame:
    """key, first, last, n: maximal runs of consecutive rows for which ``member`` holds, and of one ``kind``."""
    w = Window.partitionBy(key).orderBy(order)
    kind = F.lit(0) if kind is None else kind
    marked = rows.select(key, order, F.when(member, kind).alias("_k"))
    turn = ~F.col("_k").eqNullSafe(F.lag("_k").over(w))
    numbered = marked.withColumn("_run", F.sum(F.when(turn, 1).otherwise(0)).over(w)).where("_k is not null")
    return numbered.groupBy(key, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")


def comment_blocks(rows: DataFrame, key: str, markers: tuple[str, ...] = ("///", "//!", "//", "#!", "#", "--"), over: int = 2, heading: str = r"^\W*[-=─═]{3,}", fence: str | None = r"^# ///") -> DataFrame:
    """key, first, n: runs of more than ``over`` comment lines with the same marker.

    A heading (a rule of dashes) ends a run and doesn't count.  Lines between
    a pair of ``fence`` lines are script metadata and don't count either.
    """
    trimmed = F.ltrim("text")
    marker = F.coalesce(*[F.when(F.startswith(trimmed, F.lit(m)), m) for m in markers])
    body = F.coalesce(*[F.when(F.startswith(trimmed, F.lit(m)), F.substr(trimmed, F.lit(len(m) + 1))) for m in markers])
    w = Window.partitionBy(key).orderBy("line")
    held = rows.withColumn("_marker", marker).withColumn("_heading", body.rlike(heading))
    if fence:
        edge = trimmed.rlike(fence)
        before = F.sum(F.when(edge, 1).otherwise(0)).over(w)
        held = held.withColumn("_inside", edge | (before % 2 == 1))
    else:
        held = held.withColumn("_inside", F.lit(False))
    found = islands(held, key, "line", F.col("_marker").isNotNull() & ~F.coalesce("_heading", F.lit(False)) & ~F.col("_inside"), F.col("_marker"))
    return found.where(F.col("n") > over).select(key, "first", "n")


def ranges(rows: DataFrame, key: str, number: str) -> DataFrame:
    """key, ranges: the distinct numbers of each key as ``3-5, 9``."""
    runs = islands_of_numbers(rows, key, number)
    text = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    return runs.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", text.alias("t")))), lambda x: x["t"]), ", ").alias("ranges"))


def islands_of_numbers(rows: DataFrame, key: str, number: str) -> DataFrame:
    """key, first, last: maximal runs of consecutive numbers."""
    w = Window.partitionBy(key).orderBy(number)
    numbered = rows.select(key, number).distinct().withColumn("_run", F.col(number) - F.row_number().over(w))
    return numbered.groupBy(key, "_run").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("_run")


def span_union(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """key, covered: the length that half-open spans of each key cover, overlaps once."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    part = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(reach, F.col(start))))
    return rows.where(F.col(end) > F.col(start)).withColumn("_part", part).groupBy(key).agg(F.sum("_part").alias("covered"))


def carried(rows: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """Rows with the last value that isn't null, this row's included, as a new column."""
    return rows.withColumn(name, F.last_value(value, ignoreNulls=F.lit(True)).over(Window.partitionBy(key).orderBy(order)))


def first_difference(left: Column, right: Column) -> Column:
    """The first place (from 0) where two arrays differ, their common length if one begins the other, null if equal."""
    n = F.greatest(F.size(left), F.size(right))
    places = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: ~F.get(left, i).eqNullSafe(F.get(right, i)) & (i < n))
    return F.when(F.size(places) > 0, F.get(places, F.lit(0)))


def multiset_delta(before: DataFrame, after: DataFrame, token: str) -> DataFrame:
    """token, delta: how many more or fewer of each token there are after; tokens whose count holds are left out."""
    step = lambda df, n: df.select(token, F.lit(n).alias("_n"))
    return step(after, 1).unionByName(step(before, -1)).groupBy(token).agg(F.sum("_n").alias("delta")).where("delta <> 0")


def stride_groups(rows: DataFrame, key: str, order: str, largest: int = 32) -> DataFrame:
    """Rows with ``part``: every n-th row of a key to the same group, so that no group holds more than ``largest``."""
    placed = ranked(rows, [key], [F.asc(order)], "_place", "_all")
    parts = F.ceil(F.col("_all") / F.lit(largest))
    return placed.withColumn("part", ((F.col("_place") - 1) % parts).cast("bigint")).drop("_place", "_all")


def group_time(rows: DataFrame, keys: list[str], seconds: str) -> DataFrame:
    """Keys and the total of a group, null as soon as one member is unknown, so that unknown groups can go first."""
    return rows.groupBy(*keys).agg(F.when(F.count(seconds) == F.count(F.lit(1)), F.sum(seconds)).alias("total"))


def even_split(total: Column, members: Column, rank: Column) -> Column:
    """A member's part of a total split evenly, the rest to the first (rank 1)."""
    return (total - total % members) / members + F.when(rank == 1, total % members).otherwise(0)
