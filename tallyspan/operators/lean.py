"""What merging repeated runs would save: sites, kinds of merge, a choice without shared lines, and the report by file."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .graph import staged
from .sequences import even_split
from .similar import lines_saved, run_sites


@F.pandas_udf(ArrayType(IntegerType()))
def _apart(firsts: pd.Series, lines: pd.Series) -> pd.Series:
    """Of sorted places of one run in one file those that begin after the one kept before has ended."""

    def keep(places, n):
        kept, end = [], None
        for p in places:
            if end is None or p >= end:
                kept.append(p)
                end = p + n
        return kept

    return pd.Series([keep(p, n) for p, n in zip(firsts, lines, strict=True)])


def merges(rows: DataFrame, key: str, line: str, symbol, least: int = 3, least_saved: int = 1) -> DataFrame:
    """run, key, first, lines, sites, kind, saves: every site of the merges that are worth it and share no line.

    Sites of a run that overlap in a file count once, the earlier one.  A run
    whose sites follow each other in one file becomes a ``table``, any other a
    ``function``.  Of merges that share a line the one that saves more stays.
    """
    each = run_sites(rows, key, line, symbol, least).groupBy("run", key, "lines").agg(F.array_sort(F.collect_list("first")).alias("_at"))
    each = each.withColumn("_at", _apart("_at", "lines")).withColumn("_n", F.size("_at"))
    ends = F.element_at("_at", -1) - F.element_at("_at", 1)
    each = staged(each.withColumn("_row", ends == F.col("lines") * (F.col("_n") - 1)))
    totals = each.groupBy("run").agg(F.sum("_n").alias("sites"), F.when((F.count(F.lit(1)) == 1) & F.bool_and("_row"), "table").otherwise("function").alias("kind"))
    found = each.join(totals.where("sites > 1"), "run").withColumn("saves", lines_saved(F.col("lines"), F.col("sites"), F.col("kind")))
    found = found.where(F.col("saves") >= least_saved).select("run", key, F.explode("_at").alias("first"), "lines", "sites", "kind", "saves")
    return chosen(found, key)


def chosen(sites: DataFrame, key: str) -> DataFrame:
    """Sites (run, key, first, lines, saves, ...) of runs chosen greedily, so that none shares a line with another.

    Most saved first; of equal ones the one whose first site comes first, then
    the longer, then the lower number.  In each round the runs that lead on all
    lines of all their sites stay, and those that share a line with them go:
    the result of going through one sorted list, in as many rounds as the
    longest chain of runs that outdo each other.
    """
    sites = staged(sites)
    place = F.struct(key, "first")
    order = sites.groupBy("run").agg(F.max("saves").alias("_s"), F.min(place).alias("_p"), F.max("lines").alias("_l"))
    order = order.select("run", F.struct(-F.col("_s"), "_p", -F.col("_l"), "run").alias("_o"))
    cells = staged(sites.join(order, "run").select("run", "_o", key, F.explode(F.sequence("first", F.expr("first + lines - 1"))).alias("_line")).distinct())
    kept = None
    while not cells.isEmpty():
        led = cells.groupBy(key, "_line").agg(F.min("_o").alias("_top"))
        beaten = staged(cells.join(led, [key, "_line"]).where("_o <> _top").select("run", F.col("_top.run").alias("_by")).distinct())
        lead = staged(cells.select("run").distinct().join(beaten, "run", "left_anti"))
        gone = beaten.join(lead.withColumnRenamed("run", "_by"), "_by", "left_semi").select("run")
        kept = lead if kept is None else kept.unionByName(lead)
        cells = staged(cells.join(gone.unionByName(lead).distinct(), "run", "left_anti"))
    return sites.limit(0) if kept is None else sites.join(kept, "run", "left_semi")


def report(merged: DataFrame, key: str) -> DataFrame:
    """key, removable, places: each file's part of what the merges save, split evenly over their sites, the rest to the first."""
    first = merged.groupBy("run").agg(F.min(F.struct(key, "first")).alias("_head"))
    rank = F.when(F.struct(key, "first") == F.col("_head"), 1).otherwise(2)
    part = even_split(F.col("saves"), F.col("sites"), rank)
    return merged.join(first, "run").groupBy(key).agg(F.sum(part).cast("bigint").alias("removable"), F.count(F.lit(1)).alias("places"))
