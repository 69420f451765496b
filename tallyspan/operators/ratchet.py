"""Keyed counts held to a record: they may fall, never rise.

A series is long form: ``measure, key, value`` with a bigint value, lower being
better, one row per key.  A policy table says for each measure how its keys
behave: ``measure, policy, basis_points, floor, unit`` where policy is

* ``measures``: a fixed set of measure names; a new one at zero is worth a note,
* ``census``: every key is always measured, so one that is gone is a finding,
* ``items``: keys come and go, and an item may move between files,
* ``sizes``: a value may grow by a tolerance, in parts of ten thousand but at least ``floor``.

Every join is by key, so a measure with most of the rows shuffles as evenly as
its keys; a hot measure alone never gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import file_of, item_of

LARGEST = (1 << 63) - 1


def saturating_add(a: Column, b: Column) -> Column:
    """The sum, or the largest bigint where it would pass that."""
    return F.coalesce(F.try_add(a, b), F.lit(LARGEST))


def allowed(was: Column, policy: Column, basis_points: Column, floor: Column) -> Column:
    """The greatest value that a record of ``was`` lets pass."""
    part = F.coalesce(F.floor(F.try_multiply(was, F.coalesce(basis_points, F.lit(0)).cast("bigint")) / F.lit(10000).cast("decimal(20,0)")).cast("bigint"), F.lit(LARGEST))
    return F.when(policy == "sizes", saturating_add(was, F.greatest(part, F.coalesce(floor, F.lit(0)).cast("bigint")))).otherwise(was)


def moved(now: DataFrame, was: DataFrame, policies: DataFrame) -> DataFrame:
    """measure, key, old_key: items that changed file, where exactly one key left and one arrived under the item's name."""
    items = policies.where("policy = 'items'").select("measure")
    only = lambda a, b: a.join(b, ["measure", "key"], "left_anti").join(items, "measure", "left_semi").withColumn("item", item_of(F.col("key"))).where("item is not null")
    one = lambda df, name: df.groupBy("measure", "item").agg(F.min("key").alias(name), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    return one(only(now, was), "key").join(one(only(was, now), "old_key"), ["measure", "item"]).select("measure", "key", "old_key")


def regressions(now: DataFrame, was: DataFrame, policies: DataFrame) -> DataFrame:
    """measure, key, change, was, now: values over what the record allows (``grew``) and values above zero that it doesn't hold (``new``).

    A moved item is held to its old key's value.
    """
    names = moved(now, was, policies)
    held = was.select("measure", F.col("key").alias("held_key"), F.col("value").alias("was"))
    keyed = now.join(names, ["measure", "key"], "left").withColumn("held_key", F.coalesce("old_key", "key"))
    met = keyed.join(held, ["measure", "held_key"], "left").join(policies, "measure")
    over = F.col("value") > allowed(F.col("was"), F.col("policy"), F.col("basis_points"), F.col("floor"))
    change = F.when(F.col("was").isNull() & (F.col("value") > 0), "new").when(over, "grew")
    return met.select("measure", "key", change.alias("change"), "was", F.col("value").alias("now")).where("change is not null")


def new_at_zero(now: DataFrame, was: DataFrame, policies: DataFrame) -> DataFrame:
    """measure, key: keys measured at zero that the record doesn't hold; a note for ``measures`` and ``census``."""
    fixed = policies.where("policy in ('measures', 'census')").select("measure")
    return now.where("value = 0").join(was, ["measure", "key"], "left_anti").join(fixed, "measure", "left_semi").select("measure", "key")


def stopped_measuring(now: DataFrame, was: DataFrame, policies: DataFrame) -> DataFrame:
    """measure, key, was, now: census keys of the record that weren't measured; ``now`` stays null, which isn't zero."""
    census = policies.where("policy = 'census'").select("measure")
    gone = was.join(now, ["measure", "key"], "left_anti").join(census, "measure", "left_semi")
    return gone.select("measure", "key", F.col("value").alias("was"), F.lit(None).cast("bigint").alias("now"))


def guards(now: DataFrame, was: DataFrame, policies: DataFrame) -> DataFrame:
    """measure, reason: measures that can't be compared.

    ``nothing measured``: a census with a record and no keys now.  ``no key in
    common``: neither side is empty, no key is on both, and the record isn't
    all zeros under ``items``.  ``other unit``: the record counts another unit.
    """
    sized = lambda df, name: df.groupBy("measure").agg(F.count(F.lit(1)).alias(f"n_{name}"), F.max("value").alias(f"top_{name}"), *([F.max("unit").alias("was_unit")] if "unit" in df.columns else []))
    common = now.join(was, ["measure", "key"], "left_semi").groupBy("measure").agg(F.count(F.lit(1)).alias("n_both"))
    all_of = policies.join(sized(now.select("measure", "key", "value"), "now"), "measure", "left").join(sized(was, "was"), "measure", "left").join(common, "measure", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    empty_now, empty_was = n("n_now") == 0, n("n_was") == 0
    debt = F.coalesce(F.col("debt"), F.lit(False)) if "debt" in policies.columns else F.lit(False)
    reason = F.when(empty_was, None)
    if "unit" in was.columns:
        reason = reason.when(F.col("was_unit") != F.col("unit"), "other unit")
    reason = reason.when(empty_now & (F.col("policy") == "census"), "nothing measured").when(empty_now, None)
    zeros = (F.col("policy") == "items") & (n("top_was") == 0)
    reason = reason.when((n("n_both") == 0) & ~zeros & ~debt, "no key in common")
    return all_of.select("measure", reason.alias("reason")).where("reason is not null")


def verdicts(now: DataFrame, was: DataFrame, policies: DataFrame, faults: DataFrame | None = None, unread: DataFrame | None = None) -> DataFrame:
    """measure, verdict, findings: ``passed`` 0, ``tripped`` 1 or ``cannot_run`` 2 for every measure of the policy table.

    ``faults`` (measure) trip whatever the record holds; ``unread`` (measure)
    names inputs that couldn't be read, which outranks a trip but hides no finding.
    """
    found = regressions(now, was, policies).select("measure").unionByName(stopped_measuring(now, was, policies).select("measure"))
    if faults is not None:
        found = found.unionByName(faults.select("measure"))
    stopped = guards(now, was, policies).select("measure")
    if unread is not None:
        stopped = stopped.unionByName(unread.select("measure"))
    counted = found.groupBy("measure").agg(F.count(F.lit(1)).alias("findings"))
    out = policies.select("measure").join(counted, "measure", "left").join(stopped.distinct().withColumn("stopped", F.lit(True)), "measure", "left")
    findings = F.coalesce("findings", F.lit(0)).cast("bigint")
    return out.select("measure", F.when(F.col("stopped"), 2).when(findings > 0, 1).otherwise(0).alias("verdict"), findings.alias("findings"))


def worst(judged: DataFrame) -> DataFrame:
    """verdict: the worst of a run; a run without measures passes."""
    return judged.agg(F.coalesce(F.max("verdict"), F.lit(0)).alias("verdict"))


def survey(now: DataFrame, policies: DataFrame) -> DataFrame:
    """measure, unit, keys, total, worst: what each measure of the policy table counts, compared with no record; one without rows counts nothing."""
    counted = now.groupBy("measure").agg(F.count(F.lit(1)).alias("keys"), F.sum("value").alias("total"), F.max("value").alias("worst"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return policies.select("measure", "unit").join(counted, "measure", "left").select("measure", "unit", zero("keys"), zero("total"), zero("worst"))


def passing_and_off(judged: DataFrame, policies: DataFrame) -> DataFrame:
    """measure: measures that are switched off though they would pass.

    ``policies`` say of each measure whether it is ``enabled``, and whether it
    is ``optional``; optional ones are a choice and never named.  A null of
    either counts as false.
    """
    off = policies.where(~F.coalesce("enabled", F.lit(False)) & ~F.coalesce("optional", F.lit(False)))
    return off.select("measure").distinct().join(judged.where("verdict = 0").select("measure"), "measure", "left_semi")


def strict(now: DataFrame) -> DataFrame:
    """The record under which every value above zero is a finding."""
    return now.select("measure", "key", F.lit(0).cast("bigint").alias("value"))


def clean_when_touched(now: DataFrame, was: DataFrame, policies: DataFrame, changed: DataFrame) -> DataFrame:
    """measure, key, was, now: items in changed files (``path``) that still count above zero, though no more than recorded."""
    items = policies.where("policy = 'items'").select("measure")
    held = was.select("measure", "key", F.col("value").alias("was"))
    kept = now.where("value > 0").join(items, "measure", "left_semi").join(held, ["measure", "key"]).where("value <= was")
    touched = kept.withColumn("path", file_of(F.col("key"))).join(changed.select("path").distinct(), "path", "left_semi")
    return touched.select("measure", "key", "was", F.col("value").alias("now"))


def tightened(now: DataFrame, was: DataFrame, policies: DataFrame) -> DataFrame:
    """measure, key, value: the record after a pass: held keys at the lesser value, moved items under their new key, gone keys dropped except a census's."""
    names = moved(now, was, policies)
    held = was.select("measure", F.col("key").alias("held_key"), F.col("value").alias("was"))
    keyed = now.join(names, ["measure", "key"], "left").withColumn("held_key", F.coalesce("old_key", "key"))
    lower = keyed.join(held, ["measure", "held_key"]).select("measure", "key", F.least("value", "was").alias("value"))
    gone = stopped_measuring(now, was, policies).select("measure", "key", F.col("was").alias("value"))
    return lower.unionByName(gone)


def raised(now: DataFrame, was: DataFrame) -> DataFrame:
    """measure, key, value: the record after accepting a run: today's keys, none lower than before."""
    held = was.select("measure", "key", F.col("value").alias("was"))
    return now.join(held, ["measure", "key"], "left").select("measure", "key", F.greatest("value", F.coalesce("was", "value")).alias("value"))


def lowered(now: DataFrame, was: DataFrame) -> DataFrame:
    """measure, key, value: the record brought down to today's values; it gains no key, and loses those not measured."""
    held = was.select("measure", "key", F.col("value").alias("was"))
    return now.join(held, ["measure", "key"]).select("measure", "key", F.least("value", "was").alias("value"))


def write_keys(now: DataFrame, was: DataFrame, named: DataFrame) -> DataFrame:
    """measure, key, value, refused: the record with the named keys (measure, key) at today's values; unchanged, and refused, if one would rise."""
    wanted = now.join(named.select("measure", "key").distinct(), ["measure", "key"], "left_semi").select("measure", "key", F.col("value").alias("now"))
    both = was.select("measure", "key", F.col("value").alias("was")).join(wanted, ["measure", "key"], "full_outer")
    # One flag for the whole write: whether any named key rises or is unknown to the record.
    rises = F.col("now").isNotNull() & (F.col("was").isNull() | (F.col("now") > F.col("was")))
    flag = both.agg(F.coalesce(F.bool_or(rises), F.lit(False)).alias("refused"))
    out = both.join(F.broadcast(flag))  # one row
    return out.where("not refused or was is not null").select("measure", "key", F.when(F.col("refused"), F.col("was")).otherwise(F.coalesce("now", "was")).alias("value"), "refused")


def moved_file(was: DataFrame, old: str, new: str) -> DataFrame:
    """measure, key, value, refused: the record with a file renamed in every measure; unchanged, and refused, if a new key is held already."""
    of_file = (F.col("key") == old) | F.startswith("key", F.lit(old + "#"))
    key = F.when(of_file, F.concat(F.lit(new), F.substr(F.col("key"), F.lit(len(old) + 1)))).otherwise(F.col("key"))
    renamed = was.select("measure", "key", key.alias("new_key"), "value")
    clash = renamed.groupBy("measure", "new_key").count().agg(F.coalesce(F.bool_or(F.col("count") > 1), F.lit(False)).alias("refused"))
    out = renamed.join(F.broadcast(clash))  # one row
    return out.select("measure", F.when(F.col("refused"), F.col("key")).otherwise(F.col("new_key")).alias("key"), "value", "refused")


def forgotten(was: DataFrame, present: DataFrame, per_file: DataFrame) -> DataFrame:
    """measure, key, value: the record without keys of files that are gone (``present``: path), for per-file measures (``per_file``: measure)."""
    keyed = was.withColumn("path", file_of(F.col("key")))
    gone = keyed.join(per_file.select("measure"), "measure", "left_semi").join(present.select("path"), "path", "left_anti")
    return was.join(gone.select("measure", "key"), ["measure", "key"], "left_anti")


def looser(now: DataFrame, was: DataFrame) -> DataFrame:
    """measure, key, was, now: keys whose record could be tighter."""
    return now.join(was.select("measure", "key", F.col("value").alias("was")), ["measure", "key"]).where("value < was").select("measure", "key", "was", F.col("value").alias("now"))


def first_record(now: DataFrame, was: DataFrame, in_ci: bool) -> DataFrame:
    """measure, verdict, records: measures without a record; on a workstation they pass and are recorded, elsewhere they can't run."""
    fresh = now.select("measure").distinct().join(was.select("measure").distinct(), "measure", "left_anti")
    return fresh.select("measure", F.lit(2 if in_ci else 0).alias("verdict"), F.lit(not in_ci).alias("records"))


def newly_measured(now: DataFrame, was: DataFrame, added: DataFrame, recorded_by: str) -> DataFrame:
    """measure, key, value: keys that a release later than the record's writer added (``added``: measure, key, since)."""
    from ..functions.text import version

    later = added.where(version(F.col("since")) > version(F.lit(recorded_by))).select("measure", "key")
    return now.join(later, ["measure", "key"], "left_semi").join(was, ["measure", "key"], "left_anti")


def debt(series: DataFrame, shown: int = 5) -> DataFrame:
    """measure, key, value, rank, total, rest: each measure's keys above zero, largest first, the first ``shown``, with what is left out.

    Only rows that can be shown reach the ranking window: each task's own
    largest, by a bounded aggregate, so a hot measure is never sorted whole.
    """
    above = series.where("value > 0")
    totals = above.groupBy("measure").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
    top = above.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(64)))
    order = [F.desc("value"), F.asc("key")]
    local = top.withColumn("_r", F.row_number().over(Window.partitionBy("measure", "_salt").orderBy(*order))).where(F.col("_r") <= shown)
    ranked = local.withColumn("rank", F.row_number().over(Window.partitionBy("measure").orderBy(*order))).where(F.col("rank") <= shown)
    return ranked.join(totals, "measure").select("measure", "key", "value", "rank", "total", F.greatest(F.col("n") - shown, F.lit(0)).alias("rest"))
