"""Measures, reports and record guards over events, line items, parts and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import declared as D
from ..operators import measures as M
from ..operators import ratchet as R
from ..operators import reports as P
from ..operators import sequences, similar
from ..operators import versions as V
from . import query
from .ratchets import _HALVES, _PARTS, _halves, _parts, _policies


@query("SELECT 'm' AS measure, 's' || l_suppkey::VARCHAR AS key, max(l_quantity - 40)::BIGINT AS value FROM lineitem WHERE l_quantity > 40 GROUP BY l_suppkey")
def worst_over_limit(read):
    """By supplier, how far its largest line item lies above a limit."""
    rows = M.over(read("lineitem"), "l_quantity", 40, rebase=True)
    return M.series(rows, "m", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.col("l_quantity"), "max")


@query("SELECT l_suppkey, max_by(l_quantity, l_orderkey * 10 + l_linenumber) AS l_quantity FROM lineitem GROUP BY l_suppkey")
def last_value(read):
    """Each supplier's last quantity."""
    rows = read("lineitem").withColumn("at", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return M.last_wins(rows, ["l_suppkey"], "at", "l_quantity")


@query("""
WITH r AS (SELECT user_id, value, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events)
SELECT user_id, value, event_type FROM r WHERE r = 1
""")
def worst_event(read):
    """Each user's largest event and its type; of events as large the first."""
    return M.worst_detail(read("events"), ["user_id"], "value", "event_id", "event_type")


@query("""
WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity = 50 GROUP BY l_partkey)
SELECT p_partkey AS key, coalesce(n, 0)::BIGINT AS value FROM part LEFT JOIN c ON l_partkey = p_partkey
""")
def census_of_parts(read):
    """Line items of fifty by part, zero where there are none."""
    found = read("lineitem").where("l_quantity = 50").groupBy(F.col("l_partkey").alias("key")).agg(F.count(F.lit(1)).alias("value"))
    return M.census(found, read("part").select(F.col("p_partkey").alias("key")))


@query("""
WITH f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'error'),
e AS (SELECT user_id, count(*) AS given FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT user_id, event_id FROM f LEFT JOIN e USING (user_id) WHERE k > coalesce(given, 0)
""")
def findings_beyond_excuses(read):
    """Errors of each user beyond as many as the user has sign-ups."""
    events = read("events").select("user_id", "event_id", "event_type")
    found, _ = M.kth_excused(events.where("event_type = 'error'").drop("event_type"), events.where("event_type = 'signup'").select("user_id"), ["user_id"], "event_id")
    return found.select("user_id", "event_id")


@query("""
WITH f AS (SELECT user_id, count(*) AS met FROM events WHERE event_type = 'error' GROUP BY user_id), e AS (SELECT user_id, count(*) AS given FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT user_id, given - coalesce(met, 0) AS unused FROM e LEFT JOIN f USING (user_id) WHERE given > coalesce(met, 0)
""")
def unused_excuses(read):
    """Sign-ups of each user that meet no error."""
    events = read("events").select("user_id", "event_id", "event_type")
    return M.kth_excused(events.where("event_type = 'error'").drop("event_type"), events.where("event_type = 'signup'").select("user_id"), ["user_id"], "event_id")[1]


@query("""
SELECT l_suppkey, count(*) FILTER (l_shipdate >= TIMESTAMP '1998-01-01') - count(*) FILTER (l_shipdate < TIMESTAMP '1998-01-01') AS delta FROM lineitem
GROUP BY l_suppkey HAVING count(*) FILTER (l_shipdate >= TIMESTAMP '1998-01-01') > count(*) FILTER (l_shipdate < TIMESTAMP '1998-01-01') ORDER BY delta DESC, l_suppkey LIMIT 3
""")
def grown_most(read):
    """The three suppliers whose line items grew most."""
    each = lambda cond: read("lineitem").where(cond).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    cut = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    return M.grown_most(each(F.col("l_shipdate") < cut), each(F.col("l_shipdate") >= cut), "l_suppkey", "n")


@query("SELECT p_name AS name, count(DISTINCT p_brand) - 1 AS value FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
def duplicate_builds(read):
    """Names of parts that several brands make."""
    return M.duplicate_builds(read("part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("version")))


@query("SELECT user_id, count(DISTINCT event_type || '|' || props) AS value FROM events GROUP BY user_id")
def diagnostics_once(read):
    """Different events of each user."""
    return M.repeated_diagnostics_once(read("events").select("user_id", F.concat_ws("|", "event_type", "props").alias("said")), ["user_id"])


@query("""
SELECT a.user_id AS function, a.event_id AS place, a.event_type AS name, 'signup' AS needs FROM events a
WHERE a.event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'signup' AND b.event_id < a.event_id)
""")
def unpaired_calls(read):
    """Purchases without a sign-up of the same user before them."""
    calls = read("events").select(F.col("user_id").alias("function"), F.col("event_id").alias("place"), F.col("event_type").alias("name"))
    rules = calls.sparkSession.createDataFrame([("purchase", "signup", True)], "name string, needs string, earlier boolean")
    return M.unpaired_calls(calls, rules)


@query("""
SELECT DISTINCT 's' || l_suppkey::VARCHAR || '/' || l_returnflag AS path, 'p' || l_partkey::VARCHAR AS name FROM lineitem
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1) AND l_suppkey <> l_partkey % 10
""")
def past_seam(read):
    """Uses of ruled parts by suppliers that may not use them; the rules name the parts of the least size."""
    uses = read("lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit("/"), "l_returnflag").alias("path"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name")).distinct()
    rules = read("part").where("p_size = 1").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), F.concat(F.lit("s"), (F.col("p_partkey") % 10).cast("string")).alias("directory"))
    return M.past_seam(uses, rules)


@query("SELECT c_custkey AS name, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 0 ELSE 1 END::BIGINT AS value FROM customer")
def pins(read):
    """Customers, 1 for those without an order."""
    return M.pins(read("customer").select(F.col("c_custkey").alias("name")), read("orders").select(F.col("o_custkey").alias("name")))


@query("""
WITH t AS (SELECT l_returnflag, sum(l_quantity::BIGINT) AS q, sum(l_linenumber) AS n FROM lineitem GROUP BY ALL)
SELECT count(*) AS targets, sum(q)::BIGINT AS quantity, sum(n)::BIGINT AS line, sum(n) * 100 > sum(q) * 2 AS refused FROM t
""")
def target_totals(read):
    """Totals by target before targets meet, and whether one is too large a share of the other."""
    rows = read("lineitem").select("l_returnflag", F.col("l_quantity").cast("bigint").alias("quantity"), F.col("l_linenumber").alias("line"))
    return P.too_many_timeouts(P.totals_per_target(rows, "l_returnflag", ["quantity", "line"]), "line", "quantity")


_REPORT = "WITH r AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)"


def _counted(read):
    return read("lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_REPORT} SELECT l_returnflag, count(*) AS n, sum(n)::BIGINT AS total FROM r GROUP BY l_returnflag")
def report_totals(read):
    """Totals by kind; a floor hides rows, not totals."""
    return P.report(_counted(read), "l_returnflag", "n", 210)[1]


@query(f"{_REPORT} SELECT * FROM r WHERE n >= 210")
def report_rows(read):
    """Rows that reach the floor."""
    return P.report(_counted(read), "l_returnflag", "n", 210)[0]


@query(f"{_REPORT}, k AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_suppkey)::INT AS rank FROM r) SELECT * FROM k WHERE rank <= 30")
def largest_first(read):
    """The thirty largest rows of each kind."""
    return P.largest_first(_counted(read), ["l_returnflag"], "n", "l_suppkey", 30)


@query("""
SELECT o_orderkey AS id, 0 AS part FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT p_partkey, 1 FROM part WHERE p_size = 1 UNION ALL SELECT c_custkey, 2 FROM customer WHERE c_acctbal < 0
""")
def findings_in_order(read):
    """Three kinds of findings one after another."""
    id = lambda t, c, cond: read(t).where(cond).select(F.col(c).cast("bigint").alias("id"))
    return P.in_order(id("orders", "o_orderkey", "o_totalprice > 400000"), id("part", "p_partkey", "p_size = 1"), id("customer", "c_custkey", "c_acctbal < 0"))


@query("""
WITH l AS (SELECT l_partkey AS name, l_suppkey AS version, min(l_orderkey) AS line FROM lineitem GROUP BY ALL)
SELECT r.name, r.version, l.line FROM (SELECT p_partkey AS name, p_partkey % 100 + 1 AS version FROM part) r LEFT JOIN l USING (name, version)
""")
def lock_lines(read):
    """Parts with the first order line of the same part and supplier."""
    reported = read("part").select(F.col("p_partkey").alias("name"), (F.col("p_partkey") % 100 + 1).alias("version"))
    return P.lock_lines(reported, read("lineitem").select(F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("version"), F.col("l_orderkey").alias("line")))


@query("SELECT o_orderkey, count(*) AS nodes, sum(l_quantity)::BIGINT AS statements FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING count(*) >= 5 AND sum(l_quantity) >= 150")
def large_enough(read):
    """Orders large enough to be compared."""
    sizes = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("nodes"), F.sum("l_quantity").cast("bigint").alias("statements"))
    return P.large_enough(sizes, nodes=5, statements=150)


@query("""
WITH r AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b, l_linenumber * 3 AS i FROM lineitem)
SELECT x.a, x.i, x.b, x.i AS j, 5 AS n, x.i + 2 AS gap FROM r x JOIN r y ON x.a = y.a AND x.b = y.b AND y.i = x.i + 3
""")
def gapped_runs(read):
    """Runs of two that go on after one line, as one."""
    i = F.col("l_linenumber") * 3
    return P.gapped(read("lineitem").select(F.col("l_suppkey").alias("a"), i.alias("i"), F.col("l_partkey").alias("b"), i.alias("j"), F.lit(2).alias("n")).distinct())


@query("""
WITH ran AS (SELECT user_id, max(ts) AS ran_at FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT user_id, count(*) AS files FROM events LEFT JOIN ran USING (user_id) WHERE event_type <> 'signup' AND (ran_at IS NULL OR ts > ran_at) GROUP BY user_id
""")
def stale_groups(read):
    """Users with events after their last sign-up."""
    events = read("events").select("user_id", "event_type", "ts")
    return P.stale_groups(events.where("event_type = 'signup'"), events.where("event_type <> 'signup'"), "user_id", "ts")


@query("SELECT DISTINCT CASE WHEN event_type IN ('binsize', 'view') AND user_id % 2 = 0 AND event_type = 'binsize' THEN 'binsize@mac' ELSE event_type END AS name FROM events UNION SELECT 'binsize@mac' UNION SELECT 'coverage@mac' UNION SELECT 'lines'")
def record_names(read):
    """Names of records, apart by system where systems differ."""
    kinds = read("events").select(F.col("event_type").alias("m"), F.lit("mac").alias("s"))
    own = kinds.sparkSession.createDataFrame([("binsize", "mac"), ("coverage", "mac"), ("lines", "mac")], "m string, s string")
    return kinds.unionByName(own).select(P.record_name(F.col("m"), F.col("s")).alias("name")).distinct()


@query("SELECT doc_id, sha256(text) AS body_sha256, '{\"doc_id\":' || doc_id::VARCHAR || ',\"body_sha256\":\"' || sha256(text) || '\"}' AS value FROM documents WHERE text IS NOT NULL")
def kills_file(read):
    """A line of JSON for each document with its digest."""
    return P.kills(read("documents").where("text is not null"), ["doc_id"], "text")


@query("""
WITH m AS (SELECT l_returnflag, l_linestatus, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT m.l_returnflag, m.l_suppkey, m.n FROM m JOIN (SELECT l_returnflag, quantile_cont(n, 0.5) AS bar FROM m GROUP BY ALL) USING (l_returnflag) WHERE n > bar
""")
def above_median(read):
    """Counts above the median of their kind."""
    rows = read("lineitem").groupBy("l_returnflag", "l_linestatus", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return P.above_median(rows, "l_returnflag", "n").select("l_returnflag", "l_suppkey", "n")


@query("""
WITH c AS (SELECT l_suppkey, l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_suppkey, l_returnflag AS flag, max(n) AS n FROM c GROUP BY ALL
""")
def merged_counts(read):
    """Counts by flag of both states merged to the greater."""
    counts = read("lineitem").groupBy("l_suppkey", "l_linestatus", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    held = counts.groupBy("l_suppkey", "l_linestatus").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("m"))
    none = F.create_map().cast("map<string,bigint>")
    sides = held.groupBy("l_suppkey").agg(*[F.coalesce(F.first(F.when(F.col("l_linestatus") == s, F.col("m")), ignorenulls=True), none).alias(f"m{s}") for s in ("O", "F")])
    return sides.select("l_suppkey", F.explode(P.merged_counts(F.col("mO"), F.col("mF"))).alias("flag", "n"))


@query(f"WITH {_HALVES} SELECT 'strict' AS measure, key, 'grew' AS change, 0::BIGINT AS was, value AS now FROM now")
def ratchet_strict(read):
    """Every value above zero against a record of zeros."""
    now, _ = _halves(read, "strict")
    return R.regressions(now, R.strict(now), _policies(now.sparkSession, "measures", "strict"))


@query(f"WITH {_HALVES} SELECT 'm' AS measure, now.key, was.value AS was, now.value AS now FROM now JOIN was USING (key) WHERE now.value < was.value")
def record_looser(read):
    """Keys whose record could be tighter."""
    return R.looser(*_halves(read, "m"))


_NAMED = "named AS (SELECT key FROM now JOIN was USING (key) WHERE now.value <= was.value)"


@query(f"WITH {_PARTS}, {_NAMED} SELECT 'parts' AS measure, was.key, CASE WHEN was.key IN (SELECT key FROM named) THEN now.value ELSE was.value END AS value, false AS refused FROM was LEFT JOIN now USING (key)")
def record_named_keys(read):
    """The record with the keys that fell at today's values."""
    now, was = _parts(read)
    fell = now.join(was.select("key", F.col("value").alias("w")), "key").where("value <= w").select("measure", "key")
    return R.write_keys(now, was, fell)


@query(f"WITH {_PARTS} SELECT 'parts' AS measure, was.key, was.value, true AS refused FROM was")
def record_refused_keys(read):
    """The record unchanged, as one of the named keys is new to it."""
    now, was = _parts(read)
    return R.write_keys(now, was, now.select("measure", "key"))


@query("SELECT m AS measure, r AS reason FROM (VALUES ('a', 'nothing measured'), ('b', 'no key in common'), ('c', 'other unit')) t(m, r)")
def guards(read):
    """Measures that can't be compared: a census without keys now, keys that all changed, another unit."""
    was = read("nation").select(F.explode(F.array(*map(F.lit, "abcd"))).alias("measure"), F.col("n_name").alias("key"), F.lit(1).cast("bigint").alias("value"))
    was = was.withColumn("unit", F.when(F.col("measure") == "c", "line(s)").otherwise("event(s)"))
    now = was.where("measure <> 'a'").select("measure", F.when(F.col("measure") == "b", F.concat("key", F.lit("!"))).otherwise(F.col("key")).alias("key"), "value")
    policies = was.sparkSession.createDataFrame([(m, "census", 0, 0, "event(s)") for m in "abcd"], "measure string, policy string, basis_points bigint, floor bigint, unit string")
    return R.guards(now, was, policies)


@query(f"""
WITH {_HALVES}, f AS (SELECT count(*) AS n FROM now)
SELECT 'm' AS measure, 2 AS verdict, false AS records FROM f WHERE n > 0
""")
def first_record_in_ci(read):
    """A measure without a record can't run where records aren't written."""
    now, was = _halves(read, "m")
    return R.first_record(now, was.where("false"), True)


# Lines with text count as comments; their length says which of two markers they have.
@query("""
WITH l AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS i, unnest(ls) AS text FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM documents WHERE text <> '')
), m AS (SELECT doc_id, i, CASE WHEN text <> '' THEN CASE WHEN length(text) % 3 = 0 THEN '#' ELSE '//' END END AS k FROM l
), t AS (SELECT *, CASE WHEN k IS DISTINCT FROM lag(k) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS turn FROM m
), r AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM t)
SELECT doc_id, min(i)::INT AS first, count(*) AS n FROM r WHERE k IS NOT NULL GROUP BY doc_id, run HAVING count(*) > 2
""")
def comment_blocks(read):
    """Runs of more than two comment lines of one marker, lines with text being made comments."""
    lines = sequences.lines(read("documents"), "doc_id", "text")
    marked = F.when(F.col("text") != "", F.when(F.char_length("text") % 3 == 0, F.lit("# x")).otherwise(F.lit("// x"))).otherwise(F.lit("code"))
    return sequences.comment_blocks(lines.withColumn("text", marked), "doc_id")


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nxt FROM lineitem)
SELECT l_orderkey FROM r GROUP BY l_orderkey HAVING bool_and(nxt IS NULL OR nxt = l_linenumber + 1) AND count(*) > 1
""")
def tandem_runs(read):
    """Orders each of whose lines begins where the one before ended."""
    return similar.tandem(read("lineitem").withColumn("one", F.lit(1)), "l_orderkey", "l_linenumber", "one")


@query("""
WITH v AS (SELECT user_id, event_id AS revision, CASE WHEN value < 20 THEN NULL ELSE event_type || ' ' || value END AS text FROM events WHERE event_type IN ('purchase', 'signup'))
, asked AS (SELECT user_id, event_id AS revision FROM events WHERE event_type NOT IN ('purchase', 'signup'))
SELECT a.user_id, a.revision, v.revision AS version, v.text FROM asked a ASOF LEFT JOIN v ON a.user_id = v.user_id AND a.revision >= v.revision
""")
def text_at_revision(read):
    """The latest purchase or sign-up of its user at each other event; small ones stand for deletions."""
    events = read("events").select("user_id", F.col("event_id").alias("revision"), "event_type", "value")
    kept = F.col("event_type").isin("purchase", "signup")
    text = F.when(~(F.col("value") < 20), F.concat(F.col("event_type"), F.lit(" "), F.col("value").cast("string")))
    return V.text_at(events.where(kept).withColumn("text", text), events.where(~kept), "user_id")


@query("""
SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.5), 4) AS median FROM lineitem GROUP BY l_suppkey
UNION ALL SELECT NULL, round(quantile_cont(l_extendedprice, 0.5), 4) FROM lineitem
""")
def exact_medians(read):
    """The median price of each supplier's line items, and of all as one hot group."""
    rows = read("lineitem").select("l_suppkey", "l_extendedprice")
    both = rows.unionByName(rows.withColumn("l_suppkey", F.lit(None).cast(rows.schema["l_suppkey"].dataType)))
    return P.medians(both, "l_suppkey", "l_extendedprice").withColumn("median", F.round("median", 4))


# The commands: every event, its properties what it printed; some codes say that it could not check.
@query("""
WITH r AS (SELECT event_type || ' ' || event_id AS name, CASE WHEN event_id % 11 = 0 THEN 3 WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS code, event_type <> 'click' AS counts,
  CASE WHEN event_id % 13 = 0 THEN 'no object' WHEN value > 300 THEN '{"many": 100001}' ELSE props END AS said FROM events)
SELECT name, CASE WHEN code = 3 THEN 'cannot run' WHEN NOT counts THEN CASE code WHEN 0 THEN 'passed' ELSE 'failed' END WHEN code <> 0 THEN 'cannot run' WHEN said = 'no object' OR said LIKE '%100001%' THEN 'refused' ELSE 'counted' END AS status,
  CASE WHEN code = 0 AND counts AND said <> 'no object' AND said NOT LIKE '%100001%' THEN 'k' END AS key, CASE WHEN code = 0 AND counts AND said <> 'no object' AND said NOT LIKE '%100001%' THEN (said->>'k')::BIGINT END AS value,
  CASE WHEN code = 3 THEN name || ' could not check (exit code 3)' WHEN NOT counts THEN CASE code WHEN 0 THEN NULL ELSE name || ' failed with exit code 1' END WHEN code <> 0 THEN name || ' did not count'
    WHEN said = 'no object' THEN name || ' printed no object of counts' WHEN said LIKE '%100001%' THEN name || ' counted more than 100000' END AS why
FROM r
""")
def judged_commands(read):
    """What each declared command comes to, through a table function in SQL."""
    id, kind = F.col("event_id"), F.col("event_type")
    code = F.when(id % 11 == 0, 3).when(id % 7 == 0, 1).otherwise(0)
    said = F.when(id % 13 == 0, "no object").when(F.col("value") > 300, '{"many": 100001}').otherwise(F.col("props"))
    runs = read("events").select(F.concat(kind, F.lit(" "), id.cast("string")).alias("name"), code.alias("code"), said.alias("said"), (kind != "click").alias("counts"), F.array(F.lit(3)).alias("cannot_run"), F.lit(False).alias("truncated"))
    return D.judge_commands(runs)
