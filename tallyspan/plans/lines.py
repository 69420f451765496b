"""Line, run and text rules over documents, pages, conversations, events and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import rules, sequences
from . import query

_LINES = "lines AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS line, unnest(ls) AS text FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM documents WHERE text <> ''))"


@query("SELECT 'lines' AS measure, 'documents' AS key, sum(length(text) - length(replace(text, chr(10), '')))::BIGINT AS value FROM documents")
def line_totals(read):
    """Line ends of all documents, one key."""
    total = read("documents").agg(F.sum(sequences.count_lines(F.col("text"))).alias("value"))
    return total.select(F.lit("lines").alias("measure"), F.lit("documents").alias("key"), "value")


@query(f"""
WITH {_LINES}, marked AS (SELECT *, length(text) BETWEEN 1 AND 60 AS short FROM lines
), runs AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS run FROM marked WHERE short
), blocks AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL HAVING count(*) > 2)
SELECT doc_id, count(*) AS blocks, max(n) AS longest FROM blocks GROUP BY doc_id
""")
def over_long_blocks(read):
    """Runs of more than two short lines in a row, per document."""
    rows = sequences.lines(read("documents"), "doc_id", "text")
    found = sequences.islands(rows, "doc_id", "line", F.length("text").between(1, 60)).where("n > 2")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.max("n").alias("longest"))


@query("""
WITH n AS (SELECT DISTINCT o_custkey, o_orderkey // 100 AS k FROM orders), r AS (SELECT o_custkey, k, k - row_number() OVER (PARTITION BY o_custkey ORDER BY k) AS run FROM n
), spans AS (SELECT o_custkey, min(k) AS a, max(k) AS b FROM r GROUP BY o_custkey, run)
SELECT o_custkey, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a::VARCHAR || '-' || b::VARCHAR END, ', ' ORDER BY a) AS ranges FROM spans GROUP BY o_custkey
""")
def line_ranges(read):
    """Hundreds of order numbers of each customer as ranges."""
    rows = read("orders").select("o_custkey", F.floor(F.col("o_orderkey") / 100).cast("bigint").alias("k"))
    return sequences.ranges(rows, "o_custkey", "k")


@query("""
WITH s AS (SELECT user_id, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + round(value * 60)::BIGINT AS b FROM events), k AS (
  SELECT user_id, a, b, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s WHERE b > a
)
SELECT user_id, sum(greatest(0, b - greatest(a, coalesce(reach, a))))::BIGINT AS covered FROM k GROUP BY user_id
""")
def span_union(read):
    """Seconds that each user's events cover, overlaps once; an event lasts its value in minutes."""
    start = F.expr("unix_seconds(cast(date_trunc('second', ts) as timestamp))")
    rows = read("events").select("user_id", start.alias("a"), (start + F.round(F.col("value") * 60).cast("bigint")).alias("b"))
    return sequences.span_union(rows, "user_id", "a", "b")


@query("""
WITH p AS (
  SELECT a.doc_id, string_split(a.text, ' ') AS x, string_split(b.text, ' ') AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1
), d AS (SELECT doc_id, [i FOR i IN range(0, greatest(len(x), len(y))) IF x[i + 1] IS DISTINCT FROM y[i + 1]] AS ds FROM p)
SELECT doc_id, ds[1]::INT AS place FROM d
""")
def first_difference(read):
    """The first word in which a document differs from the next one; null if they are equal."""
    docs = read("documents").select("doc_id", F.split("text", " ").alias("x"))
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("x").alias("y"))
    return docs.join(nxt, "doc_id").select("doc_id", sequences.first_difference(F.col("x"), F.col("y")).alias("place"))


@query("""
WITH t AS (SELECT unnest(string_split(lower(text), ' ')) AS token, CASE source WHEN 'src1' THEN 1 ELSE -1 END AS n FROM documents WHERE source IN ('src0', 'src1'))
SELECT token, sum(n)::BIGINT AS delta FROM t GROUP BY token HAVING sum(n) <> 0
""")
def token_multiset_delta(read):
    """Words that one source has more or fewer of than another."""
    of = lambda s: read("documents").where(F.col("source") == s).select(F.explode(F.split(F.lower("text"), " ")).alias("token"))
    return sequences.multiset_delta(of("src0"), of("src1"), "token")


@query("""
WITH w AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS bs, length(text) AS n FROM benchmark), b AS (SELECT item_id, unnest(bs) AS word, len(bs) AS total FROM w
), d AS (SELECT DISTINCT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM documents
), met AS (SELECT item_id, doc_id, total, count(*) AS n FROM b JOIN d USING (word) GROUP BY ALL)
SELECT item_id, doc_id FROM met WHERE n = total
""")
def word_containment(read):
    """Documents that hold every word of a benchmark item: inclusion by counting met words, not by comparing all pairs."""
    items = read("benchmark").select("item_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("bs"))
    items = items.select("item_id", F.size("bs").alias("total"), F.explode("bs").alias("word"))
    docs = read("documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("word"))
    met = docs.join(items, "word").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("total").alias("total"))
    return met.where("n = total").select("item_id", "doc_id")


PHRASES = [{"text": "license", "word": True}, {"text": "public", "word": True}, {"text": "version 2", "word": True}]
_B, _A = "(^|[^\\p{L}\\p{N}_.\\-])", "($|[^\\p{L}\\p{N}_\\-])"


@query(f"""
WITH {_LINES}, p AS (SELECT unnest(['license', 'public', 'version 2']) AS phrase)
SELECT doc_id, phrase, count(*) AS n FROM lines, p WHERE regexp_matches(lower(text), '{_B}' || phrase || '{_A}') GROUP BY ALL
""")
def phrase_hits_word(read):
    """Lines of documents that hold a phrase as whole words."""
    return rules.phrase_hits(sequences.lines(read("documents"), "doc_id", "text"), "doc_id", PHRASES)


@query(f"""
WITH {_LINES}, p AS (SELECT unnest(['the', '.co', 'licen']) AS phrase)
SELECT doc_id, phrase, count(*) AS n FROM lines, p WHERE contains(lower(text), phrase) GROUP BY ALL
""")
def phrase_hits_any(read):
    """Lines of documents that hold a phrase anywhere."""
    return rules.phrase_hits(sequences.lines(read("documents"), "doc_id", "text"), "doc_id", [{"text": x} for x in ("the", ".co", "licen")])


@query(f"""
WITH {_LINES}, p AS (SELECT DISTINCT p_name AS phrase FROM part UNION SELECT DISTINCT lower(c_mktsegment) FROM customer UNION SELECT DISTINCT w FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE length(w) > 3 AND regexp_full_match(w, '[a-z]+')
), w AS (SELECT DISTINCT doc_id, line, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word, lower(text) AS t FROM lines)
SELECT doc_id, phrase, count(*) AS n FROM (SELECT DISTINCT doc_id, line, phrase FROM w JOIN p ON word = phrase WHERE regexp_matches(t, '{_B}' || phrase || '{_A}')) GROUP BY ALL
""")
def phrase_hits_many(read):
    """Lines of documents that hold any word of the benchmark, part name or market segment: one automaton for all of them."""
    words = read("benchmark").select(F.explode(F.split("text", " ")).alias("w")).where("length(w) > 3 and w rlike '^[a-z]+$'")
    every = words.unionByName(read("part").select(F.col("p_name").alias("w"))).unionByName(read("customer").select(F.lower("c_mktsegment").alias("w"))).distinct()
    listed = [{"text": r["w"], "word": True} for r in every.orderBy("w").collect()]  # the rules, a list by nature
    return rules.phrase_hits(sequences.lines(read("documents"), "doc_id", "text"), "doc_id", listed)


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages)
SELECT page_id, path FROM p WHERE (regexp_matches(path, '^(?:[^/]+/)*en/[^/]*$') OR regexp_matches(path, '^[^/]*\.example\.org/(?:.*)$')) AND NOT regexp_matches(path, '^(?:[^/]+/)*[^/]*9[^/]*$')
""")
def glob_scope(read):
    """Pages whose path some globs include and another excludes."""
    pages = read("pages").select("page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    return pages.where(T.in_scope(F.col("path"), ["**/en/*", "*.example.org/**"], ["**/*9*"]))


@query(r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_\-]+')) AS word FROM documents), h AS (
  SELECT doc_id, CASE WHEN starts_with(word, 'AKIA') AND length(word) >= 20 THEN 'cloud key' WHEN starts_with(word, 'tion') AND length(word) >= 14 AND substr(word, 5) <> 'inthethere' THEN 'long word' END AS name FROM w
)
SELECT doc_id, name, count(*) AS n FROM h WHERE name IS NOT NULL GROUP BY ALL
""")
def shape_hits(read):
    """Words in documents that have a credential's shape."""
    shapes = [{"name": "cloud key", "prefix": "AKIA", "tail": 16}, {"name": "long word", "prefix": "tion", "tail": 10, "documented": ["inthethere"]}]
    return rules.shape_hits(read("documents"), "doc_id", "text", shapes)


@query("SELECT doc_id, 1::INT AS line, 'tag' AS kind FROM documents WHERE regexp_matches(text, '[\\x{E0000}-\\x{E007F}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]')")
def hidden_characters(read):
    """Lines of documents with characters that a reader can't see (none in this data; fixtures cover them)."""
    return rules.hidden_characters(read("documents"), "doc_id", "text")


@query(r"""
WITH m AS (SELECT conv_id, turn, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ps FROM conversations), r AS (
  SELECT conv_id, turn, unnest([
    CASE WHEN trim(replace(t, chr(10), ' ')) = '' THEN 'empty' END,
    CASE WHEN length(trim(ps[1])) > 72 THEN 'long subject' END,
    CASE WHEN ends_with(trim(ps[1]), '.') THEN 'full stop' END,
    CASE WHEN len(ps) > 1 AND trim(ps[2]) <> '' THEN 'no blank line' END,
    CASE WHEN len([x FOR x IN ps[2:] IF trim(x) <> '']) > 12 THEN 'long body' END,
    CASE WHEN len([x FOR x IN ps[2:] IF length(x) > 72 AND contains(trim(x), ' ')]) > 0 THEN 'wide line' END,
    CASE WHEN regexp_matches(t, '(?im)^(co-authored-by|generated[ -]by|assisted[ -]by)\b') THEN 'credit' END]) AS rule FROM m
)
SELECT conv_id, turn, rule FROM r WHERE rule IS NOT NULL
""")
def message_limits(read):
    """Limits of a commit message that each turn of a conversation breaks."""
    return rules.message_findings(read("conversations"), ["conv_id", "turn"], "text")


@query(r"""
WITH have AS (SELECT DISTINCT regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages), c AS (
  SELECT DISTINCT page_id, regexp_extract(url, '://[^/]*/([^?#]*)', 1) || CASE WHEN page_id % 3 = 0 THEN 'x' ELSE '' END AS cite FROM pages
)
SELECT page_id, cite FROM c WHERE NOT EXISTS (SELECT 1 FROM have WHERE path = cite OR ends_with(path, '/' || cite))
""")
def citation_missing(read):
    """Cited paths that no page's path ends with; every third citation is spoilt."""
    pages = read("pages")
    have = pages.select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    cite = F.concat(F.regexp_extract("url", "://[^/]*/([^?#]*)", 1), F.when(F.col("page_id") % 3 == 0, "x").otherwise(""))
    return rules.missing_paths(pages.select("page_id", cite.alias("cite")).distinct(), have)


@query(f"""
WITH {_LINES}, nxt AS (SELECT doc_id, line, text, lead(text) OVER (PARTITION BY doc_id ORDER BY line) AS next FROM lines), w AS (
  SELECT doc_id, line, [x FOR x IN string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+') IF x NOT IN ('', 'the', 'of', 'de')] AS a, string_split_regex(lower(next), '[^\\p{{L}}\\p{{N}}]+') AS b FROM nxt WHERE next IS NOT NULL
)
SELECT doc_id, line FROM w WHERE len(a) > 0 AND len([x FOR x IN a IF NOT list_contains(b, x)]) = 0
""")
def echo_lines(read):
    """Lines all of whose words stand in the next line."""
    from pyspark.sql import Window

    rows = sequences.lines(read("documents"), "doc_id", "text")
    nxt = F.lead("text").over(Window.partitionBy("doc_id").orderBy("line"))
    split = lambda c: F.split(F.lower(c), r"[^\p{L}\p{N}]+")
    held = rows.select("doc_id", "line", F.array_except(split("text"), F.array(*[F.lit(x) for x in ("", "the", "of", "de")])).alias("a"), split(nxt).alias("b"))
    return held.where("b is not null and size(a) > 0 and size(array_except(a, b)) = 0").select("doc_id", "line")


@query("""
WITH g AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber, l_partkey) - 1 AS r, ceil(count(*) OVER (PARTITION BY l_suppkey) / 32.0)::BIGINT AS parts FROM lineitem)
SELECT l_suppkey, r % parts AS part, count(*) AS n FROM g GROUP BY ALL
""")
def stride_groups(read):
    """Line items of a supplier dealt in turn to groups of at most 32."""
    rows = read("lineitem").select("l_suppkey", F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("a"), F.col("l_partkey").alias("b")).alias("o"))
    return sequences.stride_groups(rows, "l_suppkey", "o").groupBy("l_suppkey", "part").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH g AS (SELECT l_suppkey, CASE WHEN count(*) FILTER (l_quantity = 50 AND l_linenumber = 7) = 0 THEN sum(l_quantity) END AS total FROM lineitem GROUP BY l_suppkey), r AS (
  SELECT l_suppkey, total, row_number() OVER (ORDER BY total DESC NULLS FIRST, l_suppkey) AS place FROM g)
SELECT l_suppkey, total, place::INT AS place FROM r WHERE place <= 20
""")
def slowest_first(read):
    """The twenty suppliers to start first: unknown totals before the largest."""
    rows = read("lineitem").withColumn("q", F.when((F.col("l_quantity") != 50) | (F.col("l_linenumber") != 7), F.col("l_quantity")))
    top = sequences.group_time(rows, ["l_suppkey"], "q").orderBy(F.desc_nulls_first("total"), "l_suppkey").limit(20)
    from pyspark.sql import Window

    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_first("total"), "l_suppkey")))


@query("""
WITH g AS (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source) AS total, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)
SELECT doc_id, (total // n + CASE WHEN r = 1 THEN total % n ELSE 0 END)::BIGINT AS part FROM g
""")
def lean_even_split(read):
    """A source's characters split evenly among its documents, the rest to the first; totals join back, so a hot source is no window."""
    docs = read("documents").select("doc_id", "source", "n_chars")
    totals = docs.groupBy("source").agg(F.sum("n_chars").alias("total"), F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    rank = F.when(F.col("doc_id") == F.col("first"), 1).otherwise(2)
    return docs.join(totals, "source").select("doc_id", sequences.even_split(F.col("total"), F.col("n"), rank).cast("bigint").alias("part"))
