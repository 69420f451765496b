"""Existence, ownership, pairing and verdict joins over the star tables and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import joins as J
from . import query

_WORDS = "w AS (SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS word FROM documents)"


def _words(read):
    return read("documents").select("doc_id", "source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), 0)).alias("word"))


@query(f"""
WITH {_WORDS}, u AS (SELECT word, source, count(*) AS n FROM w GROUP BY ALL), m AS (SELECT word, count(*) AS holders FROM u GROUP BY word HAVING count(*) >= 8)
SELECT word, source, n, holders FROM u JOIN m USING (word)
""")
def owners_shared(read):
    """Long words that eight or more sources use."""
    return J.shared_by(_words(read), "word", "source", 8)


@query(f"""
WITH {_WORDS}, d AS (SELECT word, count(*) AS defs FROM w WHERE source = 'src0' GROUP BY word), m AS (SELECT word, count(*) AS mentions FROM w GROUP BY word)
SELECT word, defs, mentions FROM d JOIN m USING (word) WHERE mentions <= defs
""")
def dead_names(read):
    """Long words of one source that no other source mentions."""
    words = _words(read)
    return J.named_no_more_than_defined(words.where("source = 'src0'"), words, "word")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def unused_declared(read):
    """Parts that no large line item orders."""
    used = read("lineitem").where("l_quantity > 48").select(F.col("l_partkey").cast("bigint").alias("p_partkey"))
    return J.never_used(read("part").withColumn("p_partkey", F.col("p_partkey").cast("bigint")), used, "p_partkey")


@query("SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def used_undeclared(read):
    """Suppliers of line items that aren't among the rich ones."""
    rich = read("supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return J.undeclared(read("lineitem"), rich, "l_suppkey")


@query("""
SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 30) AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
""")
def placement(read):
    """Parts that were returned though never sold in bulk for good."""
    lines = read("lineitem").withColumn("p_partkey", F.col("l_partkey"))
    return J.only_in_tests(read("part"), lines.where("l_returnflag = 'N' and l_quantity > 30"), lines.where("l_returnflag = 'R'"), "p_partkey")


@query("""
WITH e AS (SELECT DISTINCT p_name, p_brand FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_brand) AS i, count(*) OVER (PARTITION BY p_name) AS n FROM e)
SELECT p_name, n, string_agg(p_brand, ',' ORDER BY p_brand) AS places FROM r WHERE n > 1 AND i <= 3 GROUP BY p_name, n
""")
def ambiguous_names(read):
    """Part names that several brands use, with the first three."""
    return J.ambiguous(read("part"), "p_name", "p_brand").select("p_name", "n", F.array_join("places", ",").alias("places"))


@query("""
WITH p AS (SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages), d AS (
  SELECT DISTINCT path FROM p), homes AS (SELECT DISTINCT regexp_extract(path, '^([^/]*)', 1) AS home FROM d UNION SELECT DISTINCT regexp_extract(path, '^([^/]*/en)/', 1) FROM d)
SELECT path, coalesce((SELECT arg_max(home, length(home)) FROM homes WHERE home <> '' AND starts_with(path, home || '/')), NULL) AS owner FROM d
""")
def longest_prefix_owner(read):
    """Pages' paths with the deepest home above them."""
    paths = read("pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path")).distinct()
    top = paths.select(F.regexp_extract("path", "^([^/]*)", 1).alias("home"))
    homes = top.unionByName(paths.select(F.regexp_extract("path", "^([^/]*/en)/", 1).alias("home"))).where("home <> ''")
    return J.deepest_owner(paths, homes)


_SIDES = """
old AS (SELECT o_custkey, o_orderpriority, o_totalprice AS p, o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-04-01'), new AS (SELECT o_custkey, o_orderpriority, o_totalprice AS p, o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-04-01')
"""


def _sides(read):
    cut = F.lit("1998-04-01 00:00:00").cast("timestamp_ntz")
    return read("orders").where(F.col("o_orderdate") < cut), read("orders").where(F.col("o_orderdate") >= cut)


@query(f"""
WITH {_SIDES}, a AS (SELECT o_custkey, p AS l, row_number() OVER (PARTITION BY o_custkey ORDER BY p) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM old
), b AS (SELECT o_custkey, p AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY p) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM new)
SELECT o_custkey, rn::INT AS rn, l, r FROM a JOIN b USING (o_custkey, rn, n)
""")
def ordinal_pairing(read):
    """Customers' orders of two periods paired in order of price, where there are as many."""
    old, new = _sides(read)
    return J.zip_within(old, new, ["o_custkey"], "o_totalprice")


@query(f"""
WITH {_SIDES}, a AS (SELECT o_custkey, p AS l, row_number() OVER (PARTITION BY o_custkey ORDER BY p DESC, o_orderkey) AS rn FROM old), b AS (SELECT o_custkey, p AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY p DESC, o_orderkey) AS rn FROM new)
SELECT o_custkey, rn::INT AS rn, l, r FROM a FULL JOIN b USING (o_custkey, rn)
""")
def rank_pairing(read):
    """Customers' orders of two periods paired from the dearest down."""
    old, new = _sides(read)
    return J.worst_with_worst(old, new, ["o_custkey"], "o_totalprice", "o_orderkey")


@query(f"""
WITH {_SIDES}
SELECT o_custkey, a.p AS l, min(b.p) AS r FROM (SELECT DISTINCT o_custkey, p FROM old) a JOIN (SELECT DISTINCT o_custkey, p FROM new) b USING (o_custkey) WHERE abs(a.p - b.p) <= 5000.0 GROUP BY ALL HAVING count(*) = 1
""")
def tolerance_pairing(read):
    """Orders of two periods of a customer that lie within a tolerance of one other order alone."""
    old, new = _sides(read)
    return J.within(old, new, ["o_custkey"], "o_totalprice", 5000.0)


@query("""
WITH c AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS code FROM events)
SELECT user_id, max(code)::INT AS code FROM c GROUP BY user_id
""")
def strongest_verdict(read):
    """The strongest verdict of each user over all targets."""
    code = F.expr("CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END")
    return J.strongest(read("events").select("user_id", code.alias("code")), ["user_id"], "code")


@query("""
WITH d AS (SELECT DISTINCT user_id, event_id % 997 AS mutation FROM events WHERE event_type = 'error'), one AS (SELECT mutation FROM d GROUP BY mutation HAVING count(*) = 1)
SELECT DISTINCT user_id FROM d WHERE user_id NOT IN (SELECT user_id FROM d WHERE mutation IN (SELECT mutation FROM one))
""")
def idle_tests(read):
    """Users all of whose detections another user makes too."""
    rows = read("events").where("event_type = 'error'").select("user_id", (F.col("event_id") % 997).alias("mutation"))
    return J.idle(rows, "user_id", "mutation")


@query("""
WITH l AS (SELECT l_orderkey AS file, l_linenumber AS line, bool_or(l_quantity > 10) AS ran FROM lineitem GROUP BY ALL)
SELECT file, count(*) FILTER (NOT ran) AS missed, count(*) AS found FROM l GROUP BY file
""")
def coverage_missed(read):
    """Lines of each order that no record executed; a line counts once however many records it has."""
    lines = read("lineitem").groupBy(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line")).agg(F.bool_or(F.col("l_quantity") > 10).alias("ran"))
    return lines.groupBy("file").agg(F.count(F.when(~F.col("ran"), 1)).alias("missed"), F.count(F.lit(1)).alias("found"))


@query("""
WITH s AS (SELECT user_id AS file, epoch_us(ts) // 1000000 % 86400 AS sec, event_type FROM events), f AS (
  SELECT DISTINCT file, (sec // 7200) * 7200 AS first, (sec // 7200) * 7200 + 1800 AS last FROM s WHERE event_type = 'signup')
SELECT DISTINCT s.file, s.sec AS at, f.first AS span FROM s LEFT JOIN f ON s.file = f.file AND s.sec BETWEEN f.first AND f.last
""")
def enclosing_span(read):
    """Events with the half hour of the day that holds them, of those that begin with a sign-up's two hours."""
    at = F.expr("unix_seconds(cast(date_trunc('second', ts) as timestamp)) % 86400")
    rows = read("events").select(F.col("user_id").alias("file"), at.alias("at"), "event_type")
    first = F.floor(F.col("at") / 7200).cast("bigint") * 7200
    spans = rows.where("event_type = 'signup'").select("file", first.alias("first"), (first + 1800).alias("last"), first.alias("span")).distinct()
    return J.enclosing(rows.select("file", "at").distinct(), spans, "file", "at", "span", 3600)


@query("""
WITH r AS (SELECT event_type, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank, user_id FROM events)
SELECT user_id, event_id, rank::INT AS rank FROM r WHERE rank <= 4
""")
def memo_newest(read):
    """The four newest kept verdicts of each key."""
    return J.newest(read("events"), "user_id", "ts", "event_id").select("user_id", "event_id", "rank")


@query("""
WITH n AS (SELECT user_id, event_type, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-28'), o AS (SELECT user_id, event_type, event_id FROM events WHERE ts < TIMESTAMP '2024-01-28')
SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.user_id = o.user_id AND n.event_type = o.event_type)
""")
def last_run_overlay(read):
    """The last days' rows over older ones of the same user and type."""
    rows = read("events").select("user_id", "event_type", "event_id", "ts")
    cut = F.lit("2024-01-28 00:00:00").cast("timestamp_ntz")
    return J.overlay(rows.where(F.col("ts") < cut).drop("ts"), rows.where(F.col("ts") >= cut).drop("ts"), ["user_id", "event_type"])


@query("""
WITH n AS (SELECT user_id, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-16'), o AS (SELECT user_id, event_id FROM events WHERE ts < TIMESTAMP '2024-01-16'), s AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 250)
SELECT * FROM n WHERE user_id IN (SELECT user_id FROM s) UNION ALL SELECT * FROM o WHERE user_id NOT IN (SELECT user_id FROM s)
""")
def scoped_overlay(read):
    """Rows of users in scope from the new half, of all others from the old."""
    rows = read("events")
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    part = lambda c: rows.where(c).select("user_id", "event_id")
    return J.scoped_overlay(part(F.col("ts") < cut), part(F.col("ts") >= cut), rows.where("event_type = 'purchase' and value > 250"), "user_id")


@query("""
WITH a AS (SELECT o_custkey, max(o_totalprice) AS was FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey, max(o_totalprice) AS now FROM orders WHERE o_orderkey % 2 = 1 OR o_orderkey % 3 = 0 GROUP BY 1)
SELECT o_custkey, was, now FROM a FULL JOIN b USING (o_custkey) WHERE was IS DISTINCT FROM now
""")
def changed_values(read):
    """Customers whose dearest order differs between two samples."""
    side = lambda c: read("orders").where(c).groupBy("o_custkey").agg(F.max("o_totalprice").alias("v"))
    return J.changed_values(side("o_orderkey % 2 = 0"), side("o_orderkey % 2 = 1 or o_orderkey % 3 = 0"), "o_custkey", "v")


@query("""
WITH k AS (SELECT DISTINCT p_name FROM part), a AS (SELECT DISTINCT substr(p_name, 2) AS ask FROM part), m AS (
  SELECT ask, p_name, levenshtein(ask, p_name) AS edits FROM a, k WHERE levenshtein(ask, p_name) <= greatest(1, (length(ask) + 1) // 3)
), r AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY edits, p_name) AS i FROM m)
SELECT ask, p_name, edits::INT AS edits FROM r WHERE i = 1
""")
def closest_name(read):
    """The part name nearest to each one that lost its first letter."""
    parts = read("part").select("p_name")
    return J.closest(parts.select(F.expr("substr(p_name, 2)").alias("ask")), parts, "ask", "p_name")


@query("""
WITH v AS (SELECT p_brand, (p_size // 10)::VARCHAR || '.' || (p_size % 10)::VARCHAR || '.' || (p_partkey % 12)::VARCHAR AS version, p_size // 10 AS a, p_size % 10 AS b, p_partkey % 12 AS c FROM part)
SELECT p_brand, arg_min(version, a * 10000 + b * 100 + c) AS oldest, arg_max(version, a * 10000 + b * 100 + c) AS newest FROM v GROUP BY p_brand
""")
def version_floor(read):
    """The oldest and newest of each brand's dotted versions in numeric order."""
    size = F.col("p_size")
    name = F.concat_ws(".", F.floor(size / 10).cast("string"), (size % 10).cast("string"), (F.col("p_partkey") % 12).cast("string"))
    rows = read("part").select("p_brand", name.alias("version"))
    return rows.groupBy("p_brand").agg(F.min_by("version", T.version(F.col("version"))).alias("oldest"), F.max_by("version", T.version(F.col("version"))).alias("newest"))


@query("SELECT event_type || '#k' AS key, sum((props->>'k')::BIGINT)::BIGINT AS value FROM events GROUP BY event_type")
def declared_counts(read):
    """Counts that a declared command prints as JSON, summed by key."""
    counts = F.from_json("props", "map<string,bigint>")
    rows = read("events").select("event_type", F.explode(counts).alias("k", "n"))
    return rows.groupBy(F.concat_ws("#", "event_type", "k").alias("key")).agg(F.sum("n").alias("value"))
