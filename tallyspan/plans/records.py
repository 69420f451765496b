"""Differential runs and the journal's batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as D
from ..streaming import journal
from . import query


@query(r"""
WITH a AS (SELECT conv_id AS scenario, turn AS step, regexp_replace(regexp_replace(text, '[0-9]{1,}', 'N', 'g'), '[A-Z]', 'X', 'g') AS x, role, regexp_replace(text, '[0-9]{1,}', 'N', 'g') AS t FROM conversations
), s AS (
  SELECT l.scenario, l.step, CASE WHEN l.t IS DISTINCT FROM (CASE WHEN l.scenario % 4 = 0 THEN replace(l.t, 'a', 'e') ELSE l.t END) THEN 1 ELSE 0 END AS d1, CASE WHEN l.scenario % 5 = 0 AND l.role = 'user' THEN 1 ELSE 0 END AS d2, (l.scenario % 7 = 0 AND l.step = 0) AS broken FROM a l)
SELECT scenario, CASE WHEN bool_or(broken) THEN 'error' WHEN sum(CASE WHEN broken THEN 0 ELSE d1 END) > 0 OR sum(CASE WHEN broken THEN 0 ELSE d2 END) > 0 AND scenario % 2 = 1 THEN 'different'
  WHEN sum(CASE WHEN broken THEN 0 ELSE d2 END) > 0 THEN 'allowed' ELSE 'equal' END AS verdict, sum(CASE WHEN broken THEN 0 ELSE d1 + d2 END)::BIGINT AS differences FROM s GROUP BY scenario
""")
def differential_runs(read):
    """Conversations against a copy with some texts and roles changed and some first turns missing; even scenarios may change roles."""
    turns = read("conversations").select(F.col("conv_id").alias("scenario"), F.col("turn").alias("step"), "text", "role", F.lit(False).alias("timed_out"))
    other = turns.where("not (scenario % 7 = 0 and step = 0)").withColumn("text", F.when(F.col("scenario") % 4 == 0, F.replace("text", F.lit("a"), F.lit("e"))).otherwise(F.col("text")))
    other = other.withColumn("role", F.when((F.col("scenario") % 5 == 0) & (F.col("role") == "user"), "guest").otherwise(F.col("role")))
    allowed = turns.where("scenario % 2 = 0").select("scenario", F.lit("role").alias("field")).distinct()
    return D.differential(turns, other, ["text", "role"], [{"kind": "digits", "min": 1, "token": "N"}], allowed)


@query("""
WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, epoch_us(ts) // 1000 AS ms, event_type, event_id % 9 AS id FROM events), starts AS (
  SELECT * FROM e WHERE event_type = 'click'), ends AS (SELECT * FROM e WHERE event_type = 'purchase'
), closed AS (SELECT s.user_id, s.seq, s.ms, min(n.ms) AS ended FROM starts s LEFT JOIN ends n ON n.user_id = s.user_id AND n.id = s.id AND n.seq > s.seq GROUP BY ALL)
SELECT user_id, count(*) AS opened, count(*) FILTER (ended IS NULL) AS never_ended, count(*) FILTER (ended > ms + 86400000) AS late FROM closed GROUP BY user_id
""")
def journal_deadlines(read):
    """Clicks as invocations that the next purchase of the same id ends, and those that miss a day's deadline: the stream's batch twin."""
    e = read("events").select("user_id", "event_id", "ts", F.expr("unix_millis(cast(ts as timestamp))").alias("ms"), "event_type", (F.col("event_id") % 9).alias("id"))
    return journal.deadlines(e, "user_id", "id", ["ts", "event_id"], "ms", F.col("event_type") == "click", F.col("event_type") == "purchase", 86_400_000)
