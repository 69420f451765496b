"""The ratchet operators over events (two halves of a month) and line items (parts that move between suppliers)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ratchet as R
from . import query

CUT = "2024-01-16 00:00:00"


def _halves(read, measure: str):
    events = read("events")
    key = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("#"), F.col("event_type"), F.lit("@"), F.hour("ts").cast("string"))
    half = lambda cond: events.where(cond).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("value")).select(F.lit(measure).alias("measure"), "key", "value")
    cut = F.lit(CUT).cast("timestamp_ntz")
    return half(F.col("ts") >= cut), half(F.col("ts") < cut)


def _policies(spark, policy: str, measure: str, bp: int = 0, floor: int = 0):
    return spark.createDataFrame([(measure, policy, bp, floor, "event(s)")], "measure string, policy string, basis_points bigint, floor bigint, unit string")


_HALVES = f"""
halves AS (
  SELECT 'u' || user_id::VARCHAR || '#' || event_type || '@' || extract(hour FROM ts)::VARCHAR AS key, count(*) FILTER (ts >= TIMESTAMP '{CUT}') AS n, count(*) FILTER (ts < TIMESTAMP '{CUT}') AS w FROM events GROUP BY 1
), now AS (SELECT key, n AS value FROM halves WHERE n > 0), was AS (SELECT key, w AS value FROM halves WHERE w > 0)
"""


def _changes(limit: str, measure: str) -> str:
    return f"""
WITH {_HALVES}
SELECT '{measure}' AS measure, now.key, CASE WHEN was.value IS NULL THEN 'new' ELSE 'grew' END AS change, was.value AS was, now.value AS now
FROM now LEFT JOIN was USING (key) WHERE was.value IS NULL AND now.value > 0 OR now.value > {limit}
"""


# Keys that changed hold an item whose one old key left and one new key arrived; counted here as the operator does.
_ITEMS = f"""
WITH {_HALVES}, arrived AS (
  SELECT split_part(key, '#', 2) AS item, min(key) AS key FROM now WHERE key NOT IN (SELECT key FROM was) GROUP BY 1 HAVING count(*) = 1
), gone AS (
  SELECT split_part(key, '#', 2) AS item, min(key) AS old_key FROM was WHERE key NOT IN (SELECT key FROM now) GROUP BY 1 HAVING count(*) = 1
), moved AS (SELECT key, old_key FROM arrived JOIN gone USING (item)
), held AS (
  SELECT now.key, now.value AS now, was.value AS was FROM now LEFT JOIN moved USING (key) LEFT JOIN was ON was.key = coalesce(old_key, now.key)
)
SELECT 'items' AS measure, key, CASE WHEN was IS NULL THEN 'new' ELSE 'grew' END AS change, was, now FROM held WHERE was IS NULL AND now > 0 OR now > was
"""


def _ratchet(policy: str, bp: int = 0, floor: int = 0):
    def run(read):
        now, was = _halves(read, policy)
        return R.regressions(now, was, _policies(now.sparkSession, policy, policy, bp, floor))

    return run


query(_ITEMS, "ratchet_items")(_ratchet("items"))
query(_changes("was.value", "measures"), "ratchet_measures")(_ratchet("measures"))
query(_changes("was.value + greatest(was.value * 2500 // 10000, 2)", "sizes"), "ratchet_sizes")(_ratchet("sizes", 2500, 2))


@query(f"""
WITH {_HALVES}
SELECT 'census' AS measure, was.key, was.value AS was, NULL::BIGINT AS now FROM was WHERE key NOT IN (SELECT key FROM now)
""")
def ratchet_census(read):
    """Census keys of the first half that the second didn't measure."""
    now, was = _halves(read, "census")
    return R.stopped_measuring(now, was, _policies(now.sparkSession, "census", "census"))


@query(f"""
WITH {_HALVES}, zeros AS (SELECT key FROM halves WHERE n = 0), z AS (
  SELECT key, n AS value FROM halves
)
SELECT 'census' AS measure, key FROM z WHERE value = 0 AND key IN (SELECT key FROM halves WHERE w < 2)
""")
def ratchet_new_at_zero(read):
    """Census keys at zero in the second half that a record of busy keys (two and more) doesn't hold."""
    now, was = _halves(read, "census")
    every = was.unionByName(now).select("measure", "key").distinct().join(now, ["measure", "key"], "left")
    full = every.select("measure", "key", F.coalesce("value", F.lit(0)).alias("value"))
    return R.new_at_zero(full, was.where("value >= 2"), _policies(now.sparkSession, "census", "census"))


def _parts(read):
    lines = read("lineitem")
    item = F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit("q"), F.col("l_quantity").cast("int").cast("string"))
    key = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit("#"), item)
    cut = F.lit("1998-06-01 00:00:00").cast("timestamp_ntz")
    of = lambda cond: lines.where(cond).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("value")).select(F.lit("parts").alias("measure"), "key", "value")
    return of(F.col("l_shipdate") >= cut), of(F.col("l_shipdate") < cut)


_PARTS = """
now AS (
  SELECT 's' || l_suppkey::VARCHAR || '#p' || l_partkey::VARCHAR || 'q' || l_quantity::INT::VARCHAR AS key, count(*) AS value FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01' GROUP BY 1
), was AS (
  SELECT 's' || l_suppkey::VARCHAR || '#p' || l_partkey::VARCHAR || 'q' || l_quantity::INT::VARCHAR AS key, count(*) AS value FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-06-01' GROUP BY 1
), arrived AS (
  SELECT split_part(now.key, '#', 2) AS item, min(now.key) AS key FROM now LEFT JOIN was USING (key) WHERE was.key IS NULL GROUP BY 1 HAVING count(*) = 1
), gone AS (
  SELECT split_part(was.key, '#', 2) AS item, min(was.key) AS old_key FROM was LEFT JOIN now USING (key) WHERE now.key IS NULL GROUP BY 1 HAVING count(*) = 1
), moved AS (SELECT key, old_key FROM arrived JOIN gone USING (item))
"""


@query(f"WITH {_PARTS} SELECT 'parts' AS measure, key, old_key FROM moved")
def ratchet_moved(read):
    """Parts that one supplier dropped and another took up."""
    now, was = _parts(read)
    return R.moved(now, was, _policies(now.sparkSession, "items", "parts"))


@query(f"""
WITH {_PARTS}
SELECT 'parts' AS measure, now.key, least(now.value, was.value) AS value
FROM now LEFT JOIN moved USING (key) JOIN was ON was.key = coalesce(old_key, now.key)
""")
def record_tightened(read):
    """The record of parts after a pass."""
    now, was = _parts(read)
    return R.tightened(now, was, _policies(now.sparkSession, "items", "parts"))


@query(f"WITH {_PARTS} SELECT 'parts' AS measure, now.key, greatest(now.value, coalesce(was.value, now.value)) AS value FROM now LEFT JOIN was USING (key)")
def record_raised(read):
    """The record of parts after accepting a run."""
    now, was = _parts(read)
    return R.raised(now, was)


@query(f"WITH {_PARTS} SELECT 'parts' AS measure, now.key, least(now.value, was.value) AS value FROM now JOIN was USING (key)")
def record_lowered(read):
    """The record of parts brought down."""
    now, was = _parts(read)
    return R.lowered(now, was)


@query(f"""
WITH {_PARTS}, renamed AS (SELECT CASE WHEN key LIKE 's7#%' THEN 's9000007' || substr(key, 3) ELSE key END AS key, value FROM was)
SELECT 'parts' AS measure, key, value, false AS refused FROM renamed
""")
def record_renamed(read):
    """The record of parts with one supplier renamed."""
    return R.moved_file(_parts(read)[1], "s7", "s9000007")


@query(f"""
WITH {_PARTS}
SELECT 'parts' AS measure, key, value FROM was WHERE split_part(key, '#', 1) IN (SELECT 's' || s_suppkey::VARCHAR FROM supplier WHERE s_acctbal > 0)
""")
def record_forgotten(read):
    """The record of parts without suppliers that are gone (here: in debt)."""
    was = _parts(read)[1]
    present = read("supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("path"))
    return R.forgotten(was, present, was.sparkSession.createDataFrame([("parts",)], "measure string"))


@query(f"""
WITH {_HALVES}
SELECT 'items' AS measure, now.key, was.value AS was, now.value AS now FROM now JOIN was USING (key)
WHERE now.value > 0 AND now.value <= was.value AND split_part(now.key, '#', 1) IN (SELECT DISTINCT 'u' || user_id::VARCHAR FROM events WHERE value > 200)
""")
def clean_when_touched(read):
    """Counts that held but belong to users with a large event."""
    now, was = _halves(read, "items")
    changed = read("events").where("value > 200").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"))
    return R.clean_when_touched(now, was, _policies(now.sparkSession, "items", "items"), changed)


@query("""
WITH s AS (SELECT event_type AS measure, 'u' || user_id::VARCHAR AS key, count(*) AS value FROM events GROUP BY ALL), r AS (
  SELECT *, row_number() OVER (PARTITION BY measure ORDER BY value DESC, key) AS rank, sum(value) OVER (PARTITION BY measure)::BIGINT AS total, count(*) OVER (PARTITION BY measure) AS n FROM s
)
SELECT measure, key, value, rank::INT AS rank, total, greatest(n - 5, 0) AS rest FROM r WHERE rank <= 5
""")
def debt_listing(read):
    """Events by type, the busiest five users of each and how many more there are."""
    series = read("events").groupBy(F.col("event_type").alias("measure"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key")).agg(F.count(F.lit(1)).alias("value"))
    return R.debt(series)


@query(f"""
WITH {_HALVES}, bad AS (SELECT count(*) AS n FROM now LEFT JOIN was USING (key) WHERE was.value IS NULL AND now.value > 0 OR now.value > was.value)
SELECT 'measures' AS measure, CASE WHEN n > 0 THEN 1 ELSE 0 END AS verdict, n AS findings FROM bad
""")
def ratchet_verdict(read):
    """The verdict on the second half against the first."""
    now, was = _halves(read, "measures")
    return R.verdicts(now, was, _policies(now.sparkSession, "measures", "measures"))


# Every event type is a measure of its own, counted by hour of the day; its limits come from the length of its name.
_TYPES = f"""
WITH n AS (SELECT event_type AS measure, extract(hour FROM ts) AS h, count(*) FILTER (ts >= TIMESTAMP '{CUT}') AS now, count(*) FILTER (ts < TIMESTAMP '{CUT}') AS was FROM events GROUP BY ALL)
"""


def _types(read):
    events = read("events")
    cut = F.lit(CUT).cast("timestamp_ntz")
    half = lambda c: events.where(c).groupBy(F.col("event_type").alias("measure"), F.concat(F.lit("h"), F.hour("ts").cast("string")).alias("key")).agg(F.count(F.lit(1)).alias("value"))
    size = F.length("event_type").cast("bigint")
    policies = events.select("event_type").distinct().select(
        F.col("event_type").alias("measure"), F.lit("sizes").alias("policy"), (size * 1000).alias("basis_points"), (size * 3).alias("floor"), F.lit("event(s)").alias("unit"),
        (F.col("event_type") == "error").alias("enabled"), (F.col("event_type") == "signup").alias("optional"))
    return half(F.col("ts") >= cut), half(F.col("ts") < cut), policies


@query(_TYPES + """
SELECT measure, 'event(s)' AS unit, count(*) FILTER (now > 0) AS keys, sum(now)::BIGINT AS total, max(now) AS worst FROM n GROUP BY measure
""")
def survey(read):
    """What each type of event counts in the second half, compared with nothing."""
    now, _, policies = _types(read)
    return R.survey(now, policies)


@query(_TYPES + """
, j AS (SELECT measure, count(*) FILTER (now > 0 AND (was = 0 OR now > was + greatest(was * length(measure) * 1000 // 10000, length(measure) * 3))) AS findings FROM n GROUP BY measure)
SELECT measure FROM j WHERE findings = 0 AND measure NOT IN ('error', 'signup')
""")
def passing_and_off(read):
    """Types of events that aren't watched though they would pass."""
    now, was, policies = _types(read)
    return R.passing_and_off(R.verdicts(now, was, policies), policies)
