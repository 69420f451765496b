"""Joins that measures are made of: existence, ownership, pairing by rank, matrices, verdicts.

Each joins by equality on a key first, so Spark may broadcast, sort or split a
skewed side as sizes ask; conditions on ranges are filters on such a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked


def shared_by(rows: DataFrame, value: str, holder: str, least: int = 2) -> DataFrame:
    """value, holder, n, holders: uses of a value that at least ``least`` holders share."""
    uses = rows.groupBy(value, holder).agg(F.count(F.lit(1)).alias("n"))
    many = uses.groupBy(value).agg(F.count(F.lit(1)).alias("holders")).where(F.col("holders") >= least)
    return uses.join(many, value)


def never_used(declared: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Declared keys that no use names."""
    return declared.select(key).distinct().join(used.select(key), key, "left_anti")


def undeclared(used: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """Used keys that no declaration names."""
    return never_used(used, declared, key)


def only_in_tests(declared: DataFrame, production: DataFrame, tests: DataFrame, key: str) -> DataFrame:
    """Declared keys that tests use and production doesn't."""
    return declared.select(key).distinct().join(production.select(key), key, "left_anti").join(tests.select(key), key, "left_semi")


def named_no_more_than_defined(defined: DataFrame, mentioned: DataFrame, name: str) -> DataFrame:
    """name, defs, mentions: names that occur no more often than they are defined."""
    defs = defined.groupBy(name).agg(F.count(F.lit(1)).alias("defs"))
    seen = mentioned.join(defs.select(name), name, "left_semi").groupBy(name).agg(F.count(F.lit(1)).alias("mentions"))
    return defs.join(seen, name, "left").select(name, "defs", F.coalesce("mentions", F.lit(0)).alias("mentions")).where("mentions <= defs")


def ambiguous(rows: DataFrame, name: str, place: str, shown: int = 3) -> DataFrame:
    """name, n, places: names that several places define, with the first few; the list is cut before it is gathered."""
    each = rows.select(name, place).distinct()
    few = each.withColumn("_salt", F.pmod(F.xxhash64(place), F.lit(16)))
    few = few.withColumn("_r", F.row_number().over(Window.partitionBy(name, "_salt").orderBy(place))).where(F.col("_r") <= shown)
    listed = few.groupBy(name).agg(F.slice(F.array_sort(F.collect_list(place)), 1, shown).alias("places"))
    counts = each.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return counts.join(listed, name)


def deepest_owner(paths: DataFrame, homes: DataFrame, path: str = "path", home: str = "home") -> DataFrame:
    """Paths with the deepest directory of ``homes`` above them, null for none; meets on every directory above a path."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    every = paths.select(path, F.explode(F.when(F.size(parts) > 1, above).otherwise(F.array(F.lit("")))).alias("_dir"))
    owned = every.join(homes.select(F.col(home).alias("_dir")).distinct(), "_dir").groupBy(path).agg(F.max_by("_dir", F.length("_dir")).alias("owner"))
    return paths.join(owned, path, "left")


def zip_within(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, rn, l, r: the rows of equal groups paired in order, only where both groups are of one size."""
    side = lambda df, name: ranked(df.select(*keys, F.col(order).alias(name)), keys, [F.asc(name)], "rn", "n")
    return side(left, "l").join(side(right, "r"), [*keys, "rn", "n"]).select(*keys, F.col("rn").cast("int").alias("rn"), "l", "r")


def worst_with_worst(left: DataFrame, right: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """keys, rn, l, r: the rows of equal groups paired from the highest score down; rows beyond the smaller group stay alone (null)."""
    side = lambda df, name: ranked(df.select(*keys, F.col(score).alias(name), F.col(tie).alias("_by")), keys, [F.desc(name), F.asc("_by")]).drop("_by")
    return side(left, "l").join(side(right, "r"), [*keys, "rn"], "full_outer").withColumn("rn", F.col("rn").cast("int"))


def within(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """keys, l, r: values of equal keys at most ``tolerance`` apart, where only one value on the right is.

    Meets on blocks as wide as the tolerance, so a key with many rows costs its
    neighbours and not all pairs.
    """
    block = F.floor(F.col(value) / F.lit(tolerance)).cast("bigint")
    a = left.select(*keys, F.col(value).alias("l"), F.explode(F.array(block - 1, block, block + 1)).alias("_b"))
    b = right.select(*keys, F.col(value).alias("r"), block.alias("_b")).distinct()
    near = a.join(b, [*keys, "_b"]).where(F.abs(F.col("l") - F.col("r")) <= tolerance)
    return near.groupBy(*keys, "l").agg(F.min("r").alias("r"), F.count_distinct("r").alias("_n")).where("_n = 1").drop("_n")


def marks_by_place(matrix: DataFrame, columns: DataFrame, key: str, marks: str, place: str) -> DataFrame:
    """Rows of ``columns`` (key, place from 0, ...) with the mark at their place of each matrix row.

    A matrix row whose length differs from the number of its key's columns is
    refused: its mark is null and ``refused`` true, so nothing reads it as clean.
    """
    width = columns.groupBy(key).agg(F.count(F.lit(1)).alias("_width"))
    spread = matrix.join(width, key).withColumn("refused", F.char_length(marks) != F.col("_width"))
    each = spread.select(*[c for c in matrix.columns if c != marks], "refused", F.posexplode(F.split(marks, "")).alias(place, "mark"))
    met = columns.join(each, [key, place], "left")
    return met.withColumn("mark", F.when(~F.coalesce("refused", F.lit(True)), F.col("mark")))


#: Verdicts of a mutation from weakest to strongest.  Fixed values.
MARKS = {".": 0, "-": 1, "T": 2, "C": 3, "D": 4}


def mark_code(mark: Column) -> Column:
    return F.coalesce(*[F.when(mark == k, v) for k, v in MARKS.items()])


def strongest(rows: DataFrame, keys: list[str], code: str) -> DataFrame:
    """keys and the strongest code over all targets."""
    return rows.groupBy(*keys).agg(F.max(code).alias(code))


def idle(rows: DataFrame, test: str, mutation: str) -> DataFrame:
    """Tests all of whose detections another test makes too.  ``rows`` holds detections only."""
    each = rows.select(test, mutation).distinct()
    alone = each.groupBy(mutation).agg(F.count(F.lit(1)).alias("_n"), F.min(test).alias(test)).where("_n = 1").select(test)
    return each.select(test).distinct().join(alone, test, "left_anti")


def enclosing(points: DataFrame, spans: DataFrame, key: str, at: str, name: str, width: int = 256) -> DataFrame:
    """Points with the innermost span (key, first, last, name) of their key that holds them, null for none.

    Spans meet points on blocks of ``width`` places, so a key's spans and points never all meet.
    """
    block = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    laid = spans.select(key, "first", "last", name, F.explode(F.sequence(block(F.col("first")), block(F.col("last")))).alias("_b"))
    met = points.select(key, at, block(F.col(at)).alias("_b")).distinct().join(laid, [key, "_b"]).where((F.col("first") <= F.col(at)) & (F.col(at) <= F.col("last")))
    inner = met.groupBy(key, at).agg(F.max_by(name, F.struct(F.col("first"), -F.col("last"))).alias(name))
    return points.join(inner, [key, at], "left")


def outside(points: DataFrame, spans: DataFrame, key: str, at: str) -> DataFrame:
    """Points that no span of their key holds."""
    return enclosing(points, spans.withColumn("_in", F.lit(True)), key, at, "_in").where("_in is null").drop("_in")


def overlay(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """This run's rows over the previous ones of the same keys; the others stay."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def scoped_overlay(old: DataFrame, new: DataFrame, scope: DataFrame, file: str) -> DataFrame:
    """Rows of files in scope come from the new run alone, all others from the old."""
    inside = scope.select(file).distinct()
    return new.join(inside, file, "left_semi").unionByName(old.join(inside, file, "left_anti"))


def newest(rows: DataFrame, key: str, at: str, tie: str, keep: int = 4) -> DataFrame:
    """The newest ``keep`` rows of each key, with their rank."""
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def changed_values(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key, was, now: keys whose value differs, appeared or went."""
    a, b = before.select(key, F.col(value).alias("was")), after.select(key, F.col(value).alias("now"))
    return a.join(b, key, "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))


def closest(asked: DataFrame, known: DataFrame, ask: str, name: str) -> DataFrame:
    """ask, name, edits: the known name nearest to each asked one, within a third of its length (one edit at least).

    Names meet on what stays when one piece is cut: with at most d edits one of
    d + 1 pieces of the asked name stands in the known one within d places.
    """
    limit = F.greatest(F.lit(1), F.floor((F.char_length(ask) + 1) / 3)).cast("int")
    a = asked.select(ask).distinct().withColumn("_d", limit)
    n = F.char_length(ask)
    cut = lambda i: F.floor(n * i / (F.col("_d") + 1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.col("_d")), lambda i: F.struct(F.substr(F.col(ask), cut(i) + 1, cut(i + 1) - cut(i)).alias("p"), cut(i).alias("at")))
    a = a.select(ask, "_d", F.explode(pieces).alias("x")).select(ask, "_d", F.col("x.p").alias("_p"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("x.at") - F.col("_d")), F.col("x.at") + F.col("_d"))).alias("_at"))
    longest = asked.agg(F.max(n)).first()[0] or 0  # one number: the longest piece to cut from known names
    sizes = F.sequence(F.lit(1), F.least(F.lit(max(1, longest // 2 + 1)), F.char_length(name)))
    k = known.select(name).distinct().where(F.char_length(name) > 0)
    k = k.select(name, F.explode(sizes).alias("_n")).select(name, "_n", F.explode(F.sequence(F.lit(0), F.char_length(name) - F.col("_n"))).alias("_at"))
    k = k.select(name, "_at", F.substr(F.col(name), F.col("_at") + 1, F.col("_n")).alias("_p"))
    met = a.join(k, ["_p", "_at"]).select(ask, "_d", name).distinct().withColumn("edits", F.levenshtein(ask, name)).where("edits <= _d")
    return met.groupBy(ask).agg(F.min(F.struct("edits", name)).alias("b")).select(ask, f"b.{name}", "b.edits")
