"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate that brings its share of the mixture to
its target weight.  A document's count of copies inverts the Poisson
distribution of that rate at a uniform number hashed from the seed and the
document's id, so the same seed gives the same mixture on any cluster.  Copies
are dealt to partitions, and ordered inside them, by a second hash: reading the
partitions in turn reads the mixture in a random order.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import pick, stage, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Steps of the inversion table: beyond them a Poisson of mean MAX_RATE has less than 2**-52 left.  Larger means have ``wide_table``.
STEPS = 160
MAX_RATE = 64.0
#: Copies of a document that are made in one array.
AT_ONCE = 4096
WEIGHTS = {"src0": 2.0, "src1": 3.0, "src2": 0.5}


def _hashed(digits: int, *parts) -> Column:
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, digits), 16, 10).cast("bigint")


def source_rates(docs: DataFrame, weights: dict[str, float], default_weight: float, epochs: float, max_rate: float | None = None) -> DataFrame:
    """source, size, rate: one row per source, from sums over all documents."""
    sizes = docs.groupBy("source").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("bigint").alias("size"))
    spark = docs.sparkSession
    asked = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, asked double")
    sizes = sizes.join(asked, "source", "left").withColumn("weight", F.when(F.col("size") > 0, F.coalesce("asked", F.lit(float(default_weight)))).otherwise(0.0))
    sizes = stage(sizes.select("source", "size", "weight"), "mix-sources")
    total, share = sizes.agg(F.sum("size"), F.sum("weight")).first()  # two numbers
    total, share = float(total or 0), float(share or 0.0) or 1.0
    wanted = F.lit(float(epochs)) * F.lit(total) * F.col("weight") / F.lit(share) / F.col("size")
    return sizes.withColumn("rate", F.when(F.col("size") > 0, wanted if max_rate is None else F.least(wanted, F.lit(float(max_rate)))).otherwise(0.0))


def poisson_table(rate: Column, steps: int = STEPS) -> Column:
    """The cumulative Poisson probabilities of 0..steps as an array."""
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))

    def step(held: Column, k: Column) -> Column:
        p = held["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(held["c"], F.array(F.element_at(held["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda held: held["c"])


def wide_table(rate: float | None) -> tuple[int, list[float]] | None:
    """For a mean above MAX_RATE: the least count within 12 standard deviations, and the cumulative probabilities from it on to as far above.

    Terms are relative to the largest, by logarithms, so none underflows where it matters; their number grows with the root of the mean.
    """
    if rate is None or rate <= MAX_RATE:
        return None
    reach = 12 * math.sqrt(rate) + 40
    low = max(0, math.floor(rate - reach))
    logs = np.cumsum(np.append(0.0, np.log(rate / np.arange(low + 1, math.ceil(rate + reach) + 1))))
    sums = np.cumsum(np.exp(logs - logs.max()))
    return low, (sums / sums[-1]).tolist()


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float],
    default_weight: float = 1.0,
    epochs: float = 1.0,
    seed: int = 17,
    max_rate: float | None = None,
) -> DataFrame:
    """Replicate documents so that each source's expected share of characters is its weight.

    Args:
        weights: target weight by source; sources left out have ``default_weight``.
        epochs: expected characters of the mixture over characters of the input.
        max_rate: the most mean repetitions of a source, MAX_RATE at most; none
            unless given, so every source reaches its weight, however small.

    Returns the columns of documents, ``copy`` (1..copies), ``copies`` and
    ``shuffle_key``, dealt and ordered by ``shuffle_key``.  Other input columns
    are left out, so their names can't clash.

    A null source is a source of its own with the default weight.  Null and
    empty texts have size 0 and share their source's rate; a source of size 0
    has rate 0.  Rows that repeat an id get equal counts.  A null id hashes as
    the word ``null``.  An empty table gives an empty mixture.
    """
    docs = pick(docs, *COLUMNS).withColumn("source", F.col("source").cast("string"))
    if max_rate is not None and max_rate > MAX_RATE:
        raise ValueError(f"max_rate is {max_rate}; the inversion table reaches {MAX_RATE}")
    rates = source_rates(docs, weights, default_weight, epochs, max_rate)
    wide = F.udf(wide_table, "low bigint, steps array<double>")
    rates = stage(rates.select(F.col("source").alias("_source"), "rate", wide("rate").alias("wide")), "mix-rates")
    steps = F.when(F.col("rate") <= MAX_RATE, poisson_table(F.col("rate"))).otherwise(F.col("wide.steps"))
    rates = rates.select("_source", F.coalesce("wide.low", F.lit(0).cast("bigint")).alias("_low"), steps.alias("_steps"))
    # Sources are few and the join is by equality: Spark broadcasts them while they are small and splits hot sources beyond that.
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    uniform = _hashed(13, F.lit(f"{seed}:"), name) / F.lit(float(1 << 52))
    out = docs.withColumn("_u", uniform).join(rates, F.col("source").eqNullSafe(F.col("_source")), "inner")
    out = out.withColumn("copies", F.col("_low") + F.size(F.filter("_steps", lambda c: c <= F.col("_u")))).where("copies > 0")
    # In two steps, so that many copies of one document never stand in one array.
    out = out.select(*COLUMNS, "copies", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(copies - 1) div {AT_ONCE}"))).alias("_part"))
    out = out.select(*COLUMNS, "copies", F.explode(F.sequence(F.col("_part") * AT_ONCE + 1, F.least("copies", (F.col("_part") + 1) * AT_ONCE))).alias("copy"))
    out = out.withColumn("shuffle_key", _hashed(15, F.lit(f"{seed}:order:"), name, F.lit(":"), F.col("copy").cast("string")))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "doc_id", "copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), WEIGHTS)


def mixture_sql(source: str = "documents", seed: int = 17, steps: int = STEPS) -> str:
    """The same mixture of a table as DuckDB SQL."""
    weights = " ".join(f"WHEN source = '{k}' THEN {v!r}::DOUBLE" for k, v in WEIGHTS.items())
    return f"""
WITH RECURSIVE sizes AS (
  SELECT source, coalesce(sum(length(text)), 0)::BIGINT AS size FROM {source} GROUP BY source
), weighted AS (
  SELECT source, size, CASE WHEN size > 0 THEN CASE {weights} ELSE 1.0::DOUBLE END ELSE 0.0::DOUBLE END AS weight FROM sizes
), totals AS (
  SELECT sum(size)::DOUBLE AS total, sum(weight) AS share FROM weighted
), rates AS (
  SELECT source, CASE WHEN size > 0 THEN least(1.0::DOUBLE * total * weight / share / size, {MAX_RATE}::DOUBLE) ELSE 0.0::DOUBLE END AS rate
  FROM weighted, totals
), steps AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM steps WHERE k < {steps}
), tables AS (
  SELECT source, list(c ORDER BY k) AS cs FROM steps GROUP BY source
), counted AS (
  SELECT d.*, len([x for x in cs if x <= ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE])::BIGINT AS copies
  FROM {source} d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, text, lang, source, n_chars, copies, copy,
  ('0x' || substr(md5('{seed}:order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy::VARCHAR), 1, 15))::BIGINT AS shuffle_key
FROM (SELECT *, unnest(range(1, copies + 1))::BIGINT AS copy FROM counted WHERE copies > 0)
"""


SQL = mixture_sql()
