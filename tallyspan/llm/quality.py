"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Statistics of every text are computed inside its row.  Base rules reject on
fixed limits.  The rest are compared with their own language and source: a
minimum-covariance-determinant estimate of the transformed statistics, the best
of several starts refined by concentration steps, gives each group a centre and
a covariance that outliers can't move; a document too far from the centre, by Mahalanobis
distance, is rejected.

Quantiles come from counts over fine bins, so every aggregate combines before
the shuffle, a hot source costs no more than any other, and results don't
depend on how rows are partitioned.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import pick, stage, table

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Transformed statistics, in order, with the least standard deviation that each is taken to have in a group.
FLOORS = {"x0": 0.35, "x1": 0.05, "x2": 0.12, "x3": 0.08}
DIMS = len(FLOORS)
#: The share of a group that an estimate covers, concentration steps, and how many documents its language's estimate weighs in a group's own.
COVER, STEPS, PRIOR = 0.75, 4, 25
#: Starts of an estimate, and of how many rows one goes into a drawn start.
STARTS, PART = 4, 5
#: Probability, if a group were normal, that a document of it is rejected.
ALPHA = 1e-7
BINS = 1000


def chi2_cdf(x: float, half: int) -> float:
    """The chi-squared distribution of 2 * half degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(half))


def chi2_quantile(p_above: float, half: int) -> float:
    low, high = 0.0, 500.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - chi2_cdf(mid, half) > p_above else (low, mid)
    return high


#: What makes the covariance of the central share of a normal group that of the whole.
CONSISTENT = COVER / chi2_cdf(chi2_quantile(1 - COVER, DIMS // 2), DIMS // 2 + 1)


def _let(value: Column, use) -> Column:
    """Evaluate ``value`` once and use it many times."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(ws: Column) -> Column:
    """How many words lie in three-word windows that occur at least twice."""
    window = lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))

    def covered(marked: Column) -> Column:
        twin = F.filter(marked, lambda x, j: (F.get(marked, j - 1)["h"] == x["h"]) | (F.get(marked, j + 1)["h"] == x["h"]))
        starts = F.array_sort(F.transform(twin, lambda x: x["i"]))
        begin = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(starts, begin, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])

    def counted(grams: Column) -> Column:
        marked = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("bigint")).otherwise(_let(marked, covered))

    grams = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), window)
    return F.when(F.size(ws) < 4, F.lit(0).cast("bigint")).otherwise(_let(grams, counted))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every whole text; zeros for null."""
    docs = pick(docs, "doc_id", "lang", "source", "text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"), F.array_remove(F.split(text, SPACE), "").alias("ws"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(
        "doc_id",
        "lang",
        "source",
        F.size("ws").cast("bigint").alias("n_words"),
        F.aggregate("ws", F.lit(0).cast("bigint"), lambda n, w: n + F.char_length(w)).alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(F.col("ws")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def transformed() -> list[Column]:
    """Mean word length, and square roots of the shares of symbols, of repeated lines and of repeated words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [(F.col("word_chars") / n).alias("x0"), F.sqrt(F.col("n_symbols") / n).alias("x1"), F.sqrt(10 * F.col("n_dup_lines") / n).alias("x2"), F.sqrt(F.col("n_repeat_words") / n).alias("x3")]


def _quantile(rows: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """The least bin of ``value`` (an integer column) at or below which a share q of each group's rows lies."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy(value)
    counts = counts.withColumn("so_far", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    return counts.where(F.col("so_far") >= q * F.col("all")).groupBy(*keys).agg(F.min(value).alias("bin"))


def _medians(rows: DataFrame, columns: list[Column]) -> DataFrame:
    """key and the median of each column (named m0, m1, ...), to the nearest bin."""
    long = rows.select("key", F.posexplode(F.array(*[F.floor(c * BINS).cast("bigint") for c in columns])).alias("dim", "v"))
    found = _quantile(long, ["key", "dim"], "v", 0.5)
    return found.groupBy("key").agg(*[(F.max(F.when(F.col("dim") == i, F.col("bin"))) / float(BINS)).alias(f"m{i}") for i in range(len(columns))])


def _cholesky(cov: dict[tuple[int, int], Column]) -> list[Column]:
    """The lower triangle l00, l10, l11, ... as columns, each on the ones before it."""
    out = []
    for i in range(DIMS):
        for j in range(i + 1):
            rest = reduce(lambda a, b: a + b, [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.lit(0.0))
            value = F.sqrt(F.greatest(cov[i, j] - rest, F.lit(1e-12))) if i == j else (cov[i, j] - rest) / F.col(f"l{j}{j}")
            out.append((f"l{i}{j}", value))
    return out


def _distance() -> Column:
    """The Mahalanobis distance from the joined centre m and factor l, by forward substitution, as one array step for each dimension."""
    solved: list[Column] = []
    for i in range(DIMS):
        rest = reduce(lambda a, b: a + b, [F.col(f"l{i}{k}") * solved[k] for k in range(i)], F.lit(0.0))
        solved.append((F.col(f"x{i}") - F.col(f"m{i}") - rest) / F.col(f"l{i}{i}"))
    return F.sqrt(reduce(lambda a, b: a + b, [y * y for y in solved]))


def _with(df: DataFrame, named: list[tuple[str, Column]]) -> DataFrame:
    for name, value in named:
        df = df.withColumn(name, value)
    return df


_MODEL = ["key", *[f"m{i}" for i in range(DIMS)], *[f"l{i}{j}" for i in range(DIMS) for j in range(i + 1)]]
_TRIED = ["key", "start", *_MODEL[1:]]


def _spread_start(rows: DataFrame) -> DataFrame:
    """The first start: medians, and median deviations without covariances."""
    floors = list(FLOORS.values())
    centre = _medians(rows, [F.col(f"x{i}") for i in range(DIMS)])
    off = rows.join(centre, "key").select("key", *[F.abs(F.col(f"x{i}") - F.col(f"m{i}")).alias(f"d{i}") for i in range(DIMS)])
    spread = _medians(off, [F.col(f"d{i}") for i in range(DIMS)]).withColumnsRenamed({f"m{i}": f"s{i}" for i in range(DIMS)})
    cov = {(i, j): (F.pow(1.4826 * F.col(f"s{i}"), F.lit(2.0)) + floors[i] ** 2 if i == j else F.lit(0.0)) for i in range(DIMS) for j in range(i + 1)}
    return _with(centre.join(spread, "key").withColumn("start", F.lit(0)), _cholesky(cov)).select(*_TRIED)


def _moments(rows: DataFrame, factor: float) -> DataFrame:
    """The centre and regular covariance of each (key, start) of ``rows``, which holds places o0.. near each group to measure from."""
    floors = list(FLOORS.values())
    shifted = [F.col(f"x{i}") - F.col(f"o{i}") for i in range(DIMS)]
    sums = [F.avg(shifted[i]).alias(f"a{i}") for i in range(DIMS)] + [F.avg(shifted[i] * shifted[j]).alias(f"b{i}{j}") for i in range(DIMS) for j in range(i + 1)]
    moments = rows.groupBy("key", "start").agg(*sums, *[F.max(f"o{i}").alias(f"o{i}") for i in range(DIMS)])
    cov = {(i, j): factor * (F.col(f"b{i}{j}") - F.col(f"a{i}") * F.col(f"a{j}")) + (floors[i] ** 2 if i == j else 0.0) for i in range(DIMS) for j in range(i + 1)}
    return _with(_with(moments, [(f"m{i}", F.col(f"o{i}") + F.col(f"a{i}")) for i in range(DIMS)]), _cholesky(cov)).select(*_TRIED)


def _drawn(rows: DataFrame, first: DataFrame) -> DataFrame:
    """The other starts: moments of the whole group, and of parts of it drawn by hash of the statistics."""
    xs = [F.col(f"x{i}") for i in range(DIMS)]
    hit = [F.when(F.pmod(F.xxhash64(*xs, F.lit(k)), F.lit(PART)) == 0, F.lit(k)) for k in range(2, STARTS)]
    origin = first.select("key", *[F.col(f"m{i}").alias(f"o{i}") for i in range(DIMS)])
    drawn = rows.join(origin, "key").select("*", F.explode(F.array_compact(F.array(F.lit(1), *hit))).alias("start"))
    return _moments(drawn, 1.0)


def log_determinant() -> Column:
    """Of the covariance with the Cholesky factor l00..."""
    return 2 * reduce(lambda a, b: a + b, [F.log(F.col(f"l{i}{i}")) for i in range(DIMS)])


def estimate(rows: DataFrame) -> DataFrame:
    """key, centre m0.., Cholesky factor l00.. of the robust covariance of x0.. in each group of ``rows`` (key, x0, ...).

    Several starts (medians and median deviations, the whole group's moments,
    those of drawn parts) each take concentration steps: the COVER share of a
    group that lies nearest gives the next centre and covariance.  Of a
    group's results the one of least determinant stays, of equal ones the
    earlier start.  Floors add to the variances, so constant statistics don't
    make a covariance singular; a group of fewer rows than statistics is
    regular through them alone.
    """
    first = stage(_spread_start(rows), "mcd")
    model = stage(first.unionByName(_drawn(rows, first)), "mcd")
    group = ["key", "start"]
    for _ in range(STEPS):
        near = rows.join(model, "key").select(*group, *[F.col(f"x{i}") for i in range(DIMS)], *[F.col(f"m{i}").alias(f"o{i}") for i in range(DIMS)], F.floor(F.log1p(_distance()) * BINS).cast("bigint").alias("far"))
        inner = near.join(_quantile(near, group, "far", COVER), group).where("far <= bin")
        model = stage(_moments(inner, CONSISTENT), "mcd")
    found = F.struct(log_determinant().alias("size"), "start", *_MODEL[1:])
    return model.groupBy("key").agg(F.min(found).alias("best")).select("key", *[F.col(f"best.{c}") for c in _MODEL[1:]])


def _shrunk(own: DataFrame, prior: DataFrame) -> DataFrame:
    """The models of groups (with n, their documents) mixed with their languages', as n to PRIOR: the moments of the two populations taken together."""
    w = F.col("n") / (F.col("n") + F.lit(float(PRIOR)))
    cov_of = lambda c, i, j: reduce(lambda a, b: a + b, [F.col(f"{c}l{i}{k}") * F.col(f"{c}l{j}{k}") for k in range(j + 1)])
    off = [F.col(f"m{i}") - F.col(f"p_m{i}") for i in range(DIMS)]
    cov = {(i, j): w * cov_of("", i, j) + (1 - w) * cov_of("p_", i, j) + w * (1 - w) * off[i] * off[j] for i in range(DIMS) for j in range(i + 1)}
    centre = [(w * F.col(f"m{i}") + (1 - w) * F.col(f"p_m{i}")).alias(f"m{i}") for i in range(DIMS)]
    prior = prior.select(F.col("key").alias("prior"), *[F.col(c).alias(f"p_{c}") for c in _MODEL[1:]])
    mixed = own.join(prior, "prior").select("key", *centre, *[v.alias(f"c{i}{j}") for (i, j), v in cov.items()])
    return _with(mixed, _cholesky({ij: F.col(f"c{ij[0]}{ij[1]}") for ij in cov})).select(*_MODEL)


def judge(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """doc_id, lang, source, the statistics, base_failed, distance, kept: one row for each document.

    ``distance`` is the Mahalanobis distance within the document's language and
    source, null where the base rules reject.  A group's estimate is its own at
    any size, mixed with its language's by n / (n + PRIOR), so it doesn't turn
    at a count.  A null language or source is a value of its own.  Null and empty texts fail the base rules.  Rows
    that repeat count and are judged one by one; other columns are left out.
    """
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    stats = stage(statistics(docs).withColumns({"prior": part("lang"), "key": F.concat(part("lang"), F.lit("\x1f"), part("source"))}), "text-statistics")
    passed = stats.where(~base_failed())
    both = passed.select(F.explode(F.array("key", "prior")).alias("key"), *transformed())
    models = stage(estimate(stage(both, "text-vectors")), "text-models")
    sizes = passed.groupBy("key", "prior").agg(F.count(F.lit(1)).alias("n"))
    model = _shrunk(models.join(sizes, "key"), models)
    vectors = stats.withColumn("key", F.when(~base_failed(), F.col("key"))).select("*", *transformed()).join(model, "key", "left")
    out = vectors.withColumn("distance", _distance()).withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & (F.col("distance") <= math.sqrt(chi2_quantile(alpha, DIMS // 2)))
    return out.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", F.coalesce(kept, F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
