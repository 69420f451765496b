"""Texts at a revision: the latest version at or before each revision asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def text_at(versions: DataFrame, asked: DataFrame, path: str = "path", revision: str = "revision", text: str = "text") -> DataFrame:
    """path, revision, version, text: for each row of ``asked`` (path, revision) the latest version at or before it.

    A version with a null text is a deletion: then, and where no version came
    before, ``version`` says which one it was (or null) and the text is null.
    A version at the asked revision itself counts.  Rows that ask alike give
    rows of their own; of versions that share path and revision the greatest
    text counts.  Null paths and revisions meet nothing.

    Both sides are united and one window carries the last version's number
    forward, so no range is joined; texts stay out of it and come by an
    equi-join afterwards.
    """
    held = versions.where(F.col(path).isNotNull() & F.col(revision).isNotNull()).groupBy(F.col(path).alias("_path"), F.col(revision).alias("_version")).agg(F.max(text).alias("_text"))
    kind = versions.schema[revision].dataType.simpleString()
    marks = held.select(F.col("_path").alias("p"), F.col("_version").cast(kind).alias("r"), F.lit(0).alias("asks"), F.lit(1).cast("bigint").alias("n"))
    # Questions that repeat travel once, with their number.
    open_ones = asked.groupBy(F.col(path).alias("p"), F.col(revision).cast(kind).alias("r")).agg(F.count(F.lit(1)).alias("n")).select("p", "r", F.lit(1).alias("asks"), "n")
    order = Window.partitionBy("p").orderBy("r", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last_value(F.when(F.col("asks") == 0, F.col("r")), ignoreNulls=F.lit(True)).over(order)
    met = marks.unionByName(open_ones).withColumn("_last", F.when(F.col("p").isNotNull() & F.col("r").isNotNull(), last)).where("asks = 1")
    told = met.join(held, (F.col("p") == F.col("_path")) & (F.col("_last") == F.col("_version")), "left")
    told = told.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    return told.select(F.col("p").alias(path), F.col("r").alias(revision), F.col("_last").alias("version"), F.col("_text").alias(text))
