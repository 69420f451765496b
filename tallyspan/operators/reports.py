"""Reports over measured rows: totals, shown parts, joins of what tools report with what a tree holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def totals_per_target(rows: DataFrame, target: str, values: list[str]) -> DataFrame:
    """One row of totals: each target's sums are taken before targets meet, so a mutation of two targets counts twice; a sum that overflows is null."""
    each = rows.groupBy(target).agg(*[F.try_sum(F.col(v).cast("bigint")).alias(v) for v in values])
    return each.agg(F.count(F.lit(1)).alias("targets"), *[F.try_sum(v).alias(v) for v in values])


def too_many_timeouts(totals: DataFrame, timed_out: str, total: str, percent: int = 2, confirmed: Column | None = None) -> DataFrame:
    """The totals with ``refused``: more than ``percent`` of all timed out and no second run confirms it."""
    over = F.col(timed_out) * 100 > F.col(total) * percent
    return totals.withColumn("refused", over & ~F.coalesce(confirmed if confirmed is not None else F.lit(False), F.lit(False)))


def report(rows: DataFrame, kind: str, value: str, least: int) -> tuple[DataFrame, DataFrame]:
    """Rows of at least ``least``, and (kind, n, total) over all rows: a floor hides rows, never totals."""
    return rows.where(F.col(value) >= least), rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def largest_first(rows: DataFrame, group: list[str], value: str, place: str, shown: int) -> DataFrame:
    """The ``shown`` largest rows of each group with their rank; of rows as large the earlier place first."""
    w = Window.partitionBy(*group).orderBy(F.desc(value), place)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= shown)


def in_order(*parts: DataFrame) -> DataFrame:
    """The parts one after another: ``part`` numbers them, so that sorting by it and a part's own order gives them back."""
    return reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])


def lock_lines(reported: DataFrame, locked: DataFrame, keys: tuple[str, ...] = ("name", "version")) -> DataFrame:
    """Reported rows with ``line``: the lock file's own line of the same name and version, null where it has none; of several the first."""
    first = locked.groupBy(*keys).agg(F.min("line").alias("line"))
    return reported.drop("line").join(first, list(keys), "left")


def large_enough(rows: DataFrame, **floors: int) -> DataFrame:
    """Rows that reach every floor (column=least), as bodies must before they are compared."""
    return rows.where(reduce(lambda a, b: a & b, [F.col(c) >= n for c, n in floors.items()]))


def gapped(runs: DataFrame) -> DataFrame:
    """a, i, b, j, n, gap: two runs that match in the same pair of texts with one line between them on both sides, as one.

    ``runs`` (a, i, b, j, n) says that n lines of a from i match those of b from j.
    """
    end = lambda c: F.col(c) + F.col("n") + 1
    left = runs.select("a", "i", "b", "j", "n", end("i").alias("_i"), end("j").alias("_j"))
    right = runs.select("a", "b", F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("n").alias("_n"))
    met = left.join(right, ["a", "b", "_i", "_j"])
    return met.select("a", "i", "b", "j", (F.col("n") + 1 + F.col("_n")).alias("n"), (F.col("i") + F.col("n")).alias("gap"))


def stale_groups(last_run: DataFrame, changed: DataFrame, group: str, at: str) -> DataFrame:
    """group, files: groups with files changed after their last run, and how many; a group that never ran is stale with all its files."""
    ran = last_run.groupBy(group).agg(F.max(at).alias("_ran"))
    later = changed.join(ran, group, "left").where(F.col("_ran").isNull() | (F.col(at) > F.col("_ran")))
    return later.groupBy(group).agg(F.count(F.lit(1)).alias("files"))


#: Measures whose record differs between systems.
PER_SYSTEM = ("binsize", "bsize", "coverage", "mutest")


def record_name(measure: Column, system: Column) -> Column:
    """The name under which a record is kept: with ``@system`` for measures that systems differ in, off the first one."""
    return F.when(measure.isin(*PER_SYSTEM) & (system != "linux"), F.concat_ws("@", measure, system)).otherwise(measure)


def kills(rows: DataFrame, keys: list[str], body: str) -> DataFrame:
    """keys, body_sha256, value: a line of JSON for each mutation, with the digest of the body it was made in."""
    held = rows.select(*keys, F.sha2(F.col(body).cast("binary"), 256).alias("body_sha256"))
    return held.withColumn("value", F.to_json(F.struct(*keys, "body_sha256")))


def merged_counts(left: Column, right: Column) -> Column:
    """Two maps of counts as one: of keys that both hold the greater count; keys at zero go."""
    whole = F.map_zip_with(left, right, lambda k, a, b: F.greatest(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))))
    return F.map_filter(whole, lambda k, v: v > 0)


#: How far from the middle, as a part of a group, the sketch's bounds stand, and the sketch's accuracy; its error is a fiftieth of that.
_AROUND, _ACCURACY = 0.0005, 100_000


def medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, median: the exact median of each group, the mean of the middle two where they are two.  Nulls don't count.

    A mergeable sketch gives each group bounds close to its middle.  Rows below
    them are counted, and of those between them each value once with its
    number, all combined before the shuffle; the pick then runs over that
    slice, a thousandth of a group, so none is ever sorted or held whole.
    """
    held = rows.select(F.col(group).alias("g"), F.col(value).alias("v")).where("v is not null")
    bounds = held.groupBy("g").agg(F.percentile_approx("v", [0.5 - _AROUND, 0.5 + _AROUND], _ACCURACY).alias("b"), F.count(F.lit(1)).alias("n"))
    bounds = bounds.select(F.col("g").alias("_g"), F.col("b")[0].alias("lo"), F.col("b")[1].alias("hi"), "n")
    placed = held.join(bounds, F.col("g").eqNullSafe(F.col("_g"))).where("v <= hi")
    inside = F.when(F.col("v") >= F.col("lo"), F.col("v"))  # null for all below, which stand first
    counts = placed.groupBy("g", inside.alias("v")).agg(F.count(F.lit(1)).alias("c"), F.any_value("n").alias("n"))
    upto = F.sum("c").over(Window.partitionBy("g").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumn("upto", upto).where("v is not null")
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    picked = ranked.groupBy("g").agg(F.min(F.when(F.col("upto") >= low, F.col("v"))).alias("a"), F.min(F.when(F.col("upto") >= high, F.col("v"))).alias("b"))
    return picked.select(F.col("g").alias(group), ((F.col("a") + F.col("b")) / 2).alias("median"))


def above_median(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Rows above the median of their group.  A row per group is joined back, so hot groups may be split."""
    bar = medians(rows, group, value).withColumnsRenamed({group: "_group", "median": "_bar"})
    return rows.join(bar, F.col(group).eqNullSafe(F.col("_group"))).where(F.col(value) > F.col("_bar")).drop("_group", "_bar")
