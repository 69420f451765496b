"""Differential runs of two builds, and keys of kept verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalised


def normalise(text: Column, rules: list[dict]) -> Column:
    """A text after every rule (``kind`` hex, digits or text; ``min``, ``token``, ``text``) in turn."""
    return reduce(lambda t, r: normalised(t, r["kind"], r["token"], r.get("min", 1), r.get("text", "")), rules, text)


def differential(left: DataFrame, right: DataFrame, fields: list[str], rules: list[dict], allowed: DataFrame | None = None) -> DataFrame:
    """scenario, verdict, differences: two sides' answers (scenario, step, fields..., timed_out) compared step by step after normalising.

    ``equal``; ``allowed`` if every differing field is on the allow list
    (scenario, field); ``different``; ``error`` if a step is missing on one
    side, or timed out on either, as a timeout never equals a timeout.
    """
    side = lambda df, n: df.select("scenario", "step", F.lit(True).alias(f"has_{n}"), F.coalesce("timed_out", F.lit(False)).alias(f"late_{n}"), *[normalise(F.col(f), rules).alias(f"{f}_{n}") for f in fields])
    both = side(left, "l").join(side(right, "r"), ["scenario", "step"], "full_outer")
    broken = F.col("has_l").isNull() | F.col("has_r").isNull() | F.col("late_l") | F.col("late_r")
    differ = F.filter(F.array(*[F.when(~F.col(f"{f}_l").eqNullSafe(F.col(f"{f}_r")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    each = both.select("scenario", "step", broken.alias("broken"), F.when(~broken, differ).otherwise(F.array().cast("array<string>")).alias("fields"))
    found = each.select("scenario", "step", F.explode("fields").alias("field"))
    if allowed is None:
        open_ones = found
    else:
        open_ones = found.join(allowed.select("scenario", "field").distinct(), ["scenario", "field"], "left_anti")
    counts = found.groupBy("scenario").agg(F.count(F.lit(1)).alias("differences"))
    unmet = open_ones.groupBy("scenario").agg(F.count(F.lit(1)).alias("open"))
    out = each.groupBy("scenario").agg(F.bool_or("broken").alias("broken")).join(counts, "scenario", "left").join(unmet, "scenario", "left")
    verdict = F.when(F.col("broken"), "error").when(F.coalesce("open", F.lit(0)) > 0, "different").when(F.coalesce("differences", F.lit(0)) > 0, "allowed").otherwise("equal")
    return out.select("scenario", verdict.alias("verdict"), F.coalesce("differences", F.lit(0)).alias("differences"))


def memo_key(*parts: Column) -> Column:
    """A key for a kept verdict; null, so that nothing is kept, as soon as one part is unknown."""
    return F.when(reduce(lambda a, b: a & b, [p.isNotNull() for p in parts]), F.sha2(F.concat_ws("\x1f", *[F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")) for p in parts]), 256))


def keepable(verdicts: DataFrame) -> DataFrame:
    """Verdicts worth keeping: those that could run and have no record to write."""
    return verdicts.where("verdict < 2 and not coalesce(records, false)")


def crap(complexity: Column, covered: Column) -> Column:
    """Change risk of a function from its complexity and the percentage of it that tests cover."""
    return complexity * complexity * F.pow(1 - covered / 100, F.lit(3.0)) + complexity
