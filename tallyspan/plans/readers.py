"""The readers of tool output over texts that Spark makes from whole tables, and trees in canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import trees
from ..operators.sequences import lines
from ..sources import formats
from . import query


def _text(rows: DataFrame, keys: list[str], order: str, piece: Column, between: str = "\n") -> DataFrame:
    """keys, text: the pieces of each group in order, as one text."""
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(held, lambda x: x["t"]), between).alias("text"))


def _str(c: str) -> Column:
    return F.col(c).cast("string")


@query("""
WITH l AS (SELECT user_id, event_id, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS line FROM events)
SELECT user_id, line, CASE WHEN event_id % 13 <> 0 THEN (props->>'k')::BIGINT END AS k, CASE WHEN event_id % 13 = 0 THEN 'line ' || line END AS error FROM l
""")
def json_lines_read(read):
    """Each user's properties as JSON lines, some of them cut off."""
    texts = _text(read("events"), ["user_id"], "event_id", F.when(F.col("event_id") % 13 == 0, '{"k": ').otherwise(F.col("props")))
    return formats.json_lines(lines(texts, "user_id", "text"), "user_id", "k bigint").select("user_id", F.col("line").cast("int").alias("line"), "value.k", "error")


@query("""
WITH l AS (SELECT l_suppkey, l_orderkey, l_linenumber, max(l_quantity::INT % 3) AS ran FROM lineitem GROUP BY ALL)
SELECT 's' || l_suppkey || '/o' || l_orderkey AS file, count(*) FILTER (ran = 0) AS missed FROM l GROUP BY l_suppkey, l_orderkey
""")
def coverage_read(read):
    """Line items as coverage reports, a record for each supplier's order; quantities that three divides never ran."""
    ran = F.col("l_quantity").cast("int") % 3
    items = read("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.concat(F.lit("DA:"), _str("l_linenumber"), F.lit(","), ran.cast("string")).alias("da"))
    records = _text(items, ["l_suppkey", "l_orderkey"], "l_linenumber", F.col("da"))
    records = records.withColumn("text", F.concat(F.lit("SF:s"), _str("l_suppkey"), F.lit("/o"), _str("l_orderkey"), F.lit("\n"), F.col("text"), F.lit("\nend_of_record")))
    return formats.missed_lines(*formats.coverage(lines(_text(records, ["l_suppkey"], "l_orderkey", F.col("text")), "l_suppkey", "text"), "l_suppkey"))


@query("SELECT s_nationkey, 's' || s_suppkey AS head, 'c' || c_custkey AS item FROM customer JOIN supplier ON s_suppkey = c_custkey % 100")
def blocks_read(read):
    """Customers as indented items under their supplier's header, one listing for each nation."""
    items = read("customer").select((F.col("c_custkey") % 100).alias("s_suppkey"), "c_custkey")
    held = _text(items, ["s_suppkey"], "c_custkey", F.concat(F.lit("  c"), _str("c_custkey"))).join(read("supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
    held = held.withColumn("text", F.concat(F.lit("supplier s"), _str("s_suppkey"), F.lit("\n"), F.col("text"), F.lit("\n")))
    return formats.blocks(lines(_text(held, ["s_nationkey"], "s_suppkey", F.col("text")), "s_nationkey", "text"), "s_nationkey", r"^supplier (\S+)$")


@query("SELECT user_id, 'k ' || (props->>'k') AS message, 'src/u' || user_id || '.rs' AS file, event_id::INT AS line FROM events WHERE event_type = 'error'")
def diagnostics_read(read):
    """Error events as diagnostics with the place on a line after them, among the noise of the others."""
    said = F.concat(F.lit("error[E1]: k "), F.get_json_object("props", "$.k"), F.lit("\n  --> src/u"), _str("user_id"), F.lit(".rs:"), _str("event_id"), F.lit(":7\n   |"))
    texts = _text(read("events"), ["user_id"], "event_id", F.when(F.col("event_type") == "error", said).otherwise(F.concat(F.lit("note "), F.col("event_type"))))
    return formats.diagnostics(lines(texts, "user_id", "text"), "user_id")


@query("""
WITH b AS (SELECT p_brand, p_partkey, p_size, bool_or(p_size = 50 AND p_partkey % 5 = 0) OVER (PARTITION BY p_brand) AS refused FROM part)
SELECT p_brand, CASE WHEN p_size = 50 AND p_partkey % 5 = 0 THEN '' ELSE 'p' || p_partkey END AS name, CASE WHEN p_size = 50 AND p_partkey % 5 = 0 THEN '' ELSE p_size || '.0' END AS version, refused FROM b
""")
def listing_read(read):
    """Parts as a listing of names and versions for each brand; one line of another shape refuses the listing."""
    bad = (F.col("p_size") == 50) & (F.col("p_partkey") % 5 == 0)
    texts = _text(read("part"), ["p_brand"], "p_partkey", F.when(bad, F.lit("(no version)")).otherwise(F.concat(F.lit("p"), _str("p_partkey"), F.lit(" v"), _str("p_size"), F.lit(".0"))))
    return formats.versioned_names(lines(texts, "p_brand", "text"), "p_brand")


@query("SELECT conv_id, turn::VARCHAR AS id, coalesce(text, '') AS message FROM conversations")
def log_read(read):
    """Turns as a log of ids and messages between control characters."""
    texts = _text(read("conversations"), ["conv_id"], "turn", F.concat(_str("turn"), F.lit("\u0001"), F.coalesce("text", F.lit(""))), "\u0000")
    return formats.separated_log(texts, "conv_id", "text")


@query("""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text <> '')
SELECT doc_id, lpad(lower(hex(doc_id)), 7, '0') AS "commit", 'docs/' || doc_id || '.txt' AS path, unnest(generate_series(1, len(ls)))::BIGINT AS at, unnest(ls) AS text FROM d
""")
def patch_read(read):
    """Documents as commits that add their lines, read back from the unified log."""
    docs = read("documents").where("text <> ''").withColumn("ls", F.split("text", "\n"))
    body = F.array_join(F.transform("ls", lambda x: F.concat(F.lit("+"), x)), "\n")
    head = F.concat(F.lit("commit "), F.lpad(F.lower(F.hex("doc_id")), 7, "0"), F.lit("\n+++ b/docs/"), _str("doc_id"), F.lit(".txt\n@@ -0,0 +1,"), F.size("ls").cast("string"), F.lit(" @@\n"))
    return formats.added_lines(lines(docs.select("doc_id", F.concat(head, body).alias("text")), "doc_id", "text"), "doc_id")


_KINDS = "CASE c_mktsegment WHEN 'BUILDING' THEN 'dev' WHEN 'AUTOMOBILE' THEN 'build' END"


@query(f"SELECT 's' || c_custkey % 100 AS src, 'c' || c_custkey AS dst, coalesce({_KINDS}, 'normal') AS kind FROM customer")
def metadata_edges_read(read):
    """Customers as dependencies of packages in workspace metadata, by kind."""
    customers = read("customer").select((F.col("c_custkey") % 100).alias("s"), F.struct(F.concat(F.lit("c"), _str("c_custkey")).alias("name"), F.expr(_KINDS).alias("kind")).alias("d"))
    packages = customers.groupBy("s").agg(F.collect_list("d").alias("dependencies")).select((F.col("s") % 7).alias("g"), F.struct(_str("s").alias("id"), F.concat(F.lit("s"), _str("s")).alias("name"), "dependencies").alias("p"))
    return formats.edges_from_metadata(packages.groupBy("g").agg(F.to_json(F.struct(F.collect_list("p").alias("packages"))).alias("text")), "text")


_LEAVES = """
WITH c AS (SELECT c_nationkey, c_custkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer)
SELECT c_nationkey, 'customers[' || i || '].name' AS place, c_name AS value, NULL::VARCHAR AS error FROM c UNION ALL SELECT c_nationkey, 'customers[' || i || '].key', c_custkey::VARCHAR, NULL FROM c
"""


@query(_LEAVES)
def toml_read(read):
    """Each nation's customers as a TOML array of tables."""
    piece = F.concat(F.lit('[[customers]]\nname = "'), F.col("c_name"), F.lit('"  # said\nkey = '), _str("c_custkey"))
    return formats.leaves(_text(read("customer"), ["c_nationkey"], "c_custkey", piece), "c_nationkey", "text", "toml")


@query(_LEAVES)
def yaml_read(read):
    """The same as YAML."""
    piece = F.concat(F.lit("  - name: '"), F.col("c_name"), F.lit("'\n    key: "), _str("c_custkey"), F.lit(" # said"))
    texts = _text(read("customer"), ["c_nationkey"], "c_custkey", piece).withColumn("text", F.concat(F.lit("---\ncustomers:\n"), F.col("text")))
    return formats.leaves(texts, "c_nationkey", "text", "yaml")


@query("""
SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1)::INT AS place, l_partkey, CASE WHEN l_orderkey % 17 <> 0 THEN l_returnflag END AS mark FROM lineitem
""")
def marks_by_place(read):
    """The flags of an order's items as one row of marks, put back to the items by place; rows that are too short mark nothing."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    items = read("lineitem").select("l_orderkey", "l_partkey", "l_returnflag", (F.row_number().over(order) - 1).alias("place"))
    marks = _text(items, ["l_orderkey"], "place", F.col("l_returnflag"), "").withColumnRenamed("text", "marks")
    marks = marks.withColumn("marks", F.when(F.col("l_orderkey") % 17 == 0, F.expr("substr(marks, 2)")).otherwise(F.col("marks")))
    return J.marks_by_place(marks, items.select("l_orderkey", "place", "l_partkey"), "l_orderkey", "marks", "place").select("l_orderkey", "place", "l_partkey", "mark")


# A turn is a tree of sentences and words; words are names, and numbers are literals.
@query(r"""
WITH t AS (SELECT conv_id, turn, string_split(coalesce(text, ''), '. ') AS ss FROM conversations
), s AS (SELECT conv_id, turn, unnest(generate_series(1, len(ss))) AS si, unnest(ss) AS s FROM t
), w AS (SELECT conv_id, turn, si, unnest(generate_series(1, len(string_split(s, ' ')))) AS wi, unnest(string_split(s, ' ')) AS w FROM s
), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY si, wi) AS spot FROM w
), f AS (SELECT *, regexp_full_match(w, '[0-9]+') AS literal, min(spot) OVER (PARTITION BY conv_id, turn, w) AS first_at FROM n
), c AS (SELECT conv_id, turn, string_agg(si || ':' || CASE WHEN literal THEN '#' ELSE first_at::VARCHAR END, ' ' ORDER BY si, wi) AS form, count(*) AS words, max(si) AS sentences FROM f GROUP BY ALL
), z AS (SELECT *, count(*) OVER (PARTITION BY form) AS size FROM c)
SELECT conv_id, max(size - 1) AS value, max(words + sentences + 1) AS nodes FROM z GROUP BY conv_id
""")
def renamed_trees(read):
    """How many other turns have the form of a conversation's most copied one, whatever their words are, and the largest tree."""
    turns = read("conversations").select("conv_id", "turn", F.explode(F.array(F.coalesce("text", F.lit("")))).alias("text"))
    ids = turns.select(F.concat_ws("/", "conv_id", "turn").alias("tree"), "conv_id", F.posexplode(F.split("text", r"\. ")).alias("si", "s"))
    words = ids.select("tree", "conv_id", "si", F.posexplode(F.split("s", " ")).alias("wi", "w"))
    none = F.lit(None).cast("string")
    root = ids.select("tree").distinct().select("tree", F.lit("r").alias("node"), none.alias("parent"), F.lit(0).alias("place"), F.lit("turn").alias("kind"), none.alias("name"))
    sentences = ids.select("tree", _str("si").alias("node"), F.lit("r").alias("parent"), F.col("si").alias("place"), F.lit("sentence").alias("kind"), none.alias("name"))
    literal = F.col("w").rlike("^[0-9]+$")
    leaves = words.select("tree", F.concat_ws(".", "si", "wi").alias("node"), _str("si").alias("parent"), F.col("wi").alias("place"), F.when(literal, "number").otherwise("word").alias("kind"), F.when(~literal, F.col("w")).alias("name"))
    forms = trees.canonical(root.unionByName(sentences).unionByName(leaves))
    keys = ids.select("tree", "conv_id").distinct()
    return trees.copies(forms).join(keys, "tree").groupBy("conv_id").agg(F.max("value").alias("value"), F.max("nodes").alias("nodes"))


# Users are targets; what they did, by type and line, are mutations, and the even and the odd events two tests.
_RUNS = """
WITH e AS (SELECT user_id AS t, event_type AS op, (event_id % 40)::INT AS ln, event_id % 2 AS odd, (floor(abs(coalesce(value, 0))) % 5)::INT AS c FROM events
), m AS (SELECT t, op, ln, max(c) AS code, coalesce(max(CASE WHEN odd = 0 THEN c END), 0) AS c0, coalesce(max(CASE WHEN odd = 1 THEN c END), 0) AS c1 FROM e GROUP BY t, op, ln
), s AS (SELECT 't' || t || 'e' AS test, op, ln, c0 AS c FROM m WHERE t % 17 <> 0 UNION ALL SELECT 't' || t || 'o', op, ln, c1 FROM m WHERE t % 17 <> 0)
"""


def _results(read):
    from ..sources.results import Results

    code = F.floor(F.abs(F.coalesce("value", F.lit(0)))) % 5
    e = read("events").select(F.col("user_id").alias("t"), F.col("event_type").alias("op"), (F.col("event_id") % 40).cast("int").alias("ln"), (F.col("event_id") % 2).alias("odd"), code.cast("int").alias("c"))
    of = lambda odd: F.coalesce(F.max(F.when(F.col("odd") == odd, F.col("c"))), F.lit(0))
    m = e.groupBy("t", "op", "ln").agg(F.max("c").alias("code"), of(0).alias("c0"), of(1).alias("c1"))
    m = m.withColumn("id", F.row_number().over(Window.partitionBy("t").orderBy("op", "ln")))
    held = m.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("id", "op", "ln", "code", "c0", "c1"))).alias("ms"))
    marks = lambda c: F.array_join(F.transform("ms", lambda x: F.substr(F.lit(".-TCD"), x[c] + 1, F.lit(1))), "")
    span = lambda x: F.struct(F.concat(F.lit("src\\"), x["op"], F.lit(".rs")).alias("path"), F.array(x["ln"], F.lit(1)).alias("begin"), F.array(x["ln"], F.lit(9)).alias("end"))
    mutations = F.to_json(F.struct(F.transform("ms", lambda x: F.struct(x["id"].alias("id"), x["op"].alias("operator"), F.lit("changed").alias("display_name"), span(x).alias("origin_span"))).alias("mutations")))
    overall = F.when(F.col("t") % 17 == 0, F.substr(marks("code"), F.lit(2))).otherwise(marks("code"))
    run = F.struct(F.struct(overall.alias("overall_detections"), F.array(marks("c0"), marks("c1")).alias("test_detections")).alias("mutation_detection_matrix"))
    tests = F.transform(F.array(F.lit("e"), F.lit("o")), lambda x: F.struct(F.concat(F.lit("t"), _str("t"), x).alias("name")))
    texts = held.select("t", mutations.alias("m"), F.to_json(F.struct(tests.alias("tests"), F.array(run).alias("mutation_runs"))).alias("e"))
    return Results(texts, "t", "m", "e")


@query(_RUNS + """
, k AS (SELECT op, ln, max(code) AS code FROM m WHERE t % 17 <> 0 GROUP BY ALL), b AS (SELECT op, ln, string_agg(DISTINCT test, ',' ORDER BY test) AS killed_by FROM s WHERE c >= 3 GROUP BY ALL)
SELECT 'src/' || op || '.rs' AS file, ln AS line, code, coalesce(killed_by, '') AS killed_by FROM k LEFT JOIN b USING (op, ln)
""")
def mutation_kills(read):
    """Each mutation under the strongest verdict of all targets, with the tests that killed it; targets that don't line up are left out."""
    return _results(read).kills().select("file", F.get("begin", F.lit(0)).alias("line"), "code", F.array_join("killed_by", ",").alias("killed_by"))


@query(_RUNS + """
, d AS (SELECT * FROM s WHERE c >= 2), one AS (SELECT op, ln FROM d GROUP BY ALL HAVING count(*) = 1)
SELECT DISTINCT test FROM d WHERE test NOT IN (SELECT test FROM d JOIN one USING (op, ln))
""")
def idle_in_results(read):
    """Tests of the same all of whose detections another test makes too."""
    return _results(read).idle().select("test")


@query("SELECT DISTINCT user_id AS target, 'verdicts don''t line up with mutations' AS error FROM events WHERE user_id % 17 = 0")
def refused_results(read):
    """Targets of the same whose verdicts don't line up with their mutations."""
    return _results(read).refused
