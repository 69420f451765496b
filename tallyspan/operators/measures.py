"""Measures on relations that parsers and tools give: each returns rows that a series is counted from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import version
from .ranks import ranked


def series(rows: DataFrame, measure: str, key: Column, value: Column | None = None, how: str = "count") -> DataFrame:
    """measure, key, value: findings counted by key, or their sum, their worst, or the last in ``value``'s order."""
    by = {"count": F.count(F.lit(1)), "sum": F.sum(value), "max": F.max(value)} if value is not None else {"count": F.count(F.lit(1))}
    return rows.groupBy(key.alias("key")).agg(by[how].cast("bigint").alias("value")).select(F.lit(measure).alias("measure"), "key", "value")


def last_wins(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, value: of rows that repeat a key the last one's value."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def worst_detail(rows: DataFrame, keys: list[str], score: str, order: str, detail: str) -> DataFrame:
    """keys, score, detail: the worst row of each key; of rows as bad the first."""
    best = F.max_by(detail, F.struct(F.col(score), -F.col(order)))
    return rows.groupBy(*keys).agg(F.max(score).alias(score), best.alias(detail))


def over(rows: DataFrame, value: str, limit: int, rebase: bool = False) -> DataFrame:
    """Rows above a limit; their value counted from it if asked."""
    held = rows.where(F.col(value) > limit)
    return held.withColumn(value, F.col(value) - limit) if rebase else held


def census(measured: DataFrame, names: DataFrame, key: str = "key") -> DataFrame:
    """key, value: every name with its value, zero where nothing was measured."""
    return names.select(key).distinct().join(measured, key, "left").select(key, F.coalesce("value", F.lit(0)).cast("bigint").alias("value"))


def counted_findings(rows: DataFrame, severity: str = "severity") -> DataFrame:
    """Findings that count: advice (``note``) doesn't."""
    return rows.where(F.coalesce(F.col(severity), F.lit("")) != "note")


def kth_excused(found: DataFrame, excused: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """Findings beyond the excuses given for their key, the first found excused first; and (keys, unused) excuses that meet none."""
    given = excused.groupBy(*keys).agg(F.count(F.lit(1)).alias("_given"))
    placed = ranked(found, keys, [F.asc(order)], "_k").join(given, keys, "left")
    met = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("_met"))
    unused = given.join(met, keys, "left").select(*keys, (F.col("_given") - F.coalesce("_met", F.lit(0))).alias("unused")).where("unused > 0")
    return placed.where(F.col("_k") > F.coalesce("_given", F.lit(0))).drop("_k", "_given"), unused


def movable_reference(uses: Column) -> Column:
    """Whether an action or image is named by something that can move: no full revision and no content digest; local paths can't move."""
    local = uses.rlike(r"^\.{1,2}/")
    pinned = uses.rlike(r"@[0-9a-f]{40}$|@sha256:[0-9a-f]{64}$")
    return uses.isNotNull() & ~local & ~pinned


def unpinned_dependency(requirement: Column, source: Column) -> Column:
    """Whether a dependency is held to neither a version nor a full revision; of a source's parameters only ``rev`` holds it."""
    any_version = requirement.isNull() | F.trim(requirement).isin("", "*")
    full = F.coalesce(source, F.lit("")).rlike(r"[?&]rev=[0-9a-f]{40}(&|#|$)")
    from_repository = F.coalesce(source, F.lit("")).rlike(r"^git\+")
    return F.when(from_repository, ~full).otherwise(any_version)


def loose_toolchain(channel: Column) -> Column:
    """Whether a toolchain channel is neither an exact release nor a dated nightly."""
    return ~F.coalesce(channel, F.lit("")).rlike(r"^(\d+\.\d+\.\d+|nightly-\d{4}-\d{2}-\d{2})$")


def build_time_code(packages: DataFrame, members: DataFrame) -> DataFrame:
    """name, kind: packages outside the workspace (``members``: id) that run code while building, once for each kind.

    ``packages`` is id, name, targets (array of kinds).
    """
    kinds = packages.select("id", "name", F.explode("targets").alias("kind")).where(F.col("kind").isin("custom-build", "proc-macro"))
    return kinds.join(members.select("id"), "id", "left_anti").select("name", "kind").distinct()


def oldest_promise(promises: DataFrame, name: str = "version") -> DataFrame:
    """version: the oldest in numeric order."""
    return promises.agg(F.min_by(name, version(F.col(name))).alias(name))


def grown_most(before: DataFrame, after: DataFrame, key: str, value: str, shown: int = 3) -> DataFrame:
    """key, delta: the keys that grew most."""
    step = lambda df, sign: df.select(key, (F.col(value) * sign).alias("_d"))
    delta = step(after, 1).unionByName(step(before, -1)).groupBy(key).agg(F.sum("_d").alias("delta"))
    return delta.where("delta > 0").orderBy(F.desc("delta"), key).limit(shown)


def duplicate_builds(listed: DataFrame) -> DataFrame:
    """name, value: builds of a package beyond the first."""
    each = listed.select("name", "version").distinct()
    return each.groupBy("name").agg((F.count(F.lit(1)) - 1).alias("value")).where("value > 0")


def repeated_diagnostics_once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value: different diagnostics counted by key; one that a build prints for several targets counts once."""
    return rows.distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("value"))


def unpaired_calls(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """Calls (function, place, name) whose function lacks the call that a rule (name, needs, earlier) asks for, before it if ``earlier``."""
    asked = calls.join(rules, "name")
    held = calls.select(F.col("function").alias("_f"), F.col("name").alias("_n"), F.col("place").alias("_p"))
    met = (F.col("function") == F.col("_f")) & (F.col("needs") == F.col("_n")) & (~F.col("earlier") | (F.col("_p") < F.col("place")))
    return asked.join(held, met, "left_anti").select("function", "place", "name", "needs")


def past_seam(uses: DataFrame, allowed: DataFrame) -> DataFrame:
    """Uses (path, name) outside the directories (name, directory) that may use the name; names without an entry are free."""
    ruled = uses.join(allowed.select("name").distinct(), "name", "left_semi")
    inside = ruled.join(allowed.withColumnRenamed("name", "_n"), (F.col("name") == F.col("_n")) & F.startswith("path", F.concat(F.col("directory"), F.lit("/"))), "left_semi")
    return ruled.join(inside.select("path", "name").distinct(), ["path", "name"], "left_anti").select("path", "name")


def pins(asked: DataFrame, present: DataFrame, name: str = "name") -> DataFrame:
    """name, value: 0 for a pin whose test is there, 1 for a lost one."""
    held = present.select(name).distinct().withColumn("_here", F.lit(True))
    return asked.select(name).distinct().join(held, name, "left").select(name, F.when(F.col("_here"), 0).otherwise(1).cast("bigint").alias("value"))


def accepted_leaks(found: DataFrame, accepted: DataFrame, least: int = 7) -> DataFrame:
    """Leaks (rule, path, commit) that no entry (rule, path, commit prefix of ``least`` and more characters, reason) accepts."""
    good = accepted.where((F.char_length("commit") >= least) & (F.trim(F.coalesce("reason", F.lit(""))) != "")).select(F.col("rule").alias("_r"), F.col("path").alias("_p"), F.col("commit").alias("_c"))
    return found.join(good, (F.col("rule") == F.col("_r")) & (F.col("path") == F.col("_p")) & F.startswith("commit", F.col("_c")), "left_anti")
