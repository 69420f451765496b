"""Rules on lines and texts: phrases, shapes, hidden characters, echoes, citations, message limits, waivers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .patterns import phrases_in, shapes_in
from .sequences import lines


def phrase_hits(rows: DataFrame, key: str, rules: list[dict], path: str | None = None) -> DataFrame:
    """key, phrase, n: lines that hold a forbidden phrase.

    A rule has ``text``, ``word`` (whole words, else anywhere) and, where keys
    are paths, ``in`` and ``except`` globs.
    """
    return phrases_in(rows, key, rules, path=path).groupBy(key, "phrase").agg(F.count(F.lit(1)).alias("n"))


def shape_hits(df: DataFrame, key: str, text: str, shapes: list[dict]) -> DataFrame:
    """key, name, n: words of each text that have a credential's shape (``name``, ``prefix``, ``tail``, ``documented``)."""
    return shapes_in(df, key, text, shapes).groupBy(key, "name").agg(F.count(F.lit(1)).alias("n"))


def hidden_characters(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, kind: lines that hold characters a reader can't see."""
    return lines(df, key, text).select(key, "line", T.hidden(F.col("text")).alias("kind")).where("kind is not null")


def echoes(rows: DataFrame, key: str, comment: Column, filler: tuple[str, ...] = ("the", "a", "an", "of", "to", "and", "is", "for", "in")) -> DataFrame:
    """key, line: comment lines all of whose words stand in the next line; filler words don't count, and some word must remain."""
    w = Window.partitionBy(key).orderBy("line")
    held = rows.select(key, "line", comment.alias("_says"), F.lead("text").over(w).alias("_next"), F.lead(comment.isNull()).over(w).alias("_code"))
    said = F.array_except(T.words_of(F.col("_says")), F.array(*[F.lit(x) for x in filler]))
    echo = (F.size(said) > 0) & (F.size(F.array_except(said, T.words_of(T.blank_quotes(F.col("_next"))))) == 0)
    return held.where(F.col("_says").isNotNull() & F.col("_code") & echo).select(key, "line")


def missing_paths(cited: DataFrame, present: DataFrame, cite: str = "cite", path: str = "path") -> DataFrame:
    """Rows of ``cited`` whose path no present path equals or ends with, whole segments only.  Meets on the last segment."""
    last = lambda c: F.substring_index(F.col(c), "/", -1)
    held = present.select(F.col(path).alias("_path"), last(path).alias("_last")).distinct()
    match = (last(cite) == F.col("_last")) & ((F.col("_path") == F.col(cite)) | F.endswith(F.col("_path"), F.concat(F.lit("/"), F.col(cite))))
    return cited.join(held, match, "left_anti")


def message_findings(df: DataFrame, keys: list[str], text: str, subject: int = 72, body_lines: int = 12, width: int = 72, credit: str = r"(?im)^(co-authored-by|generated[ -]by|assisted[ -]by)\b") -> DataFrame:
    """keys, rule: limits that a message breaks: empty, long subject, subject ends in a full stop, no blank line, long body, wide line, credit."""
    t = F.coalesce(F.col(text), F.lit(""))
    parts = F.split(t, "\n")
    head, rest = F.trim(parts[0]), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    body = F.filter(rest, lambda x: F.trim(x) != "")
    checks = {
        "empty": F.trim(F.replace(t, F.lit("\n"), F.lit(" "))) == "",
        "long subject": F.char_length(head) > subject,
        "full stop": F.endswith(head, F.lit(".")),
        "no blank line": (F.size(rest) > 0) & (F.trim(F.get(parts, F.lit(1))) != ""),
        "long body": F.size(body) > body_lines,
        "wide line": F.exists(rest, lambda x: (F.char_length(x) > width) & F.contains(F.trim(x), F.lit(" "))),
        "credit": t.rlike(credit),
    }
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(broken).alias("rule"))


def waived(rows: DataFrame, key: str, marker: str, least: int = 8) -> DataFrame:
    """Rows with ``waived``: whether this line or the one above gives a reason of at least ``least`` characters after the marker."""
    reason = F.trim(F.regexp_extract("text", marker + r"\s*[:(]?\s*(.*)$", 1))
    here = F.char_length(reason) >= least
    return rows.withColumn("waived", here | F.coalesce(F.lag(here).over(Window.partitionBy(key).orderBy("line")), F.lit(False)))


def first_places(rows: DataFrame, keys: list[str], order: str, more: int = 20) -> DataFrame:
    """keys, line, places, n: each key's first row and up to ``more`` further ones, in order; a bounded detail of any number of rows."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(32)))
    some = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(order))).where(F.col("_r") <= more + 1)
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    listed = some.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(order)), 1, more + 1).alias("places"))
    return listed.join(counted, keys).select(*keys, F.col("places")[0].alias("line"), F.slice("places", 2, more).alias("places"), "n")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
