"""Benchmark decontamination on a distributed positional inverted index, in DataFrame functions only.

Test phrases are windows of consecutive item words.  Counts over all training
text order each window's terms by rarity; the index stores the postings (term,
document, position) of the two rarest terms of every window.  Lookup starts from
the rarest term's list, intersects it with the second's, shifted by the distance
between the two, and compares what is left with the whole phrase.  Proximity
matches allow that distance to differ by a few words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import pick, stage, table

WINDOW = 10
#: Words by which a proximity match's distance may differ from the item's.
SLOP = 3
#: Words are runs of ASCII digits and lower-case letters and of anything beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NULL = -(1 << 63)


def words(text: Column) -> Column:
    """The words of a text after lower-casing A-Z alone; none for null."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, BETWEEN), "")


def _documents(docs: DataFrame) -> DataFrame:
    """doc, text: a null id stands as the least integer while it is a key."""
    docs = pick(docs, "doc_id", "text")
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL)).alias("doc"), F.col("text").cast("string").alias("text"))


def phrases(items: DataFrame) -> DataFrame:
    """item, name, phrase: the words of every benchmark item that has any.

    ``item`` is a key of id and words: rows that repeat both count once, other
    texts of the same id apart.  ``name`` is the id as a string, ``null`` for none.
    """
    items = pick(items, "item_id", "text")
    held = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), words(F.col("text")).alias("phrase")).where(F.size("phrase") > 0)
    return held.select(F.concat_ws("#", "name", F.xxhash64("phrase").cast("string")).alias("item"), "name", "phrase").distinct()


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: how often each of ``terms`` (one column, distinct) occurs in all documents; absent terms 0."""
    every = docs.select(F.explode(words(F.col("text"))).alias("term"))
    found = every.join(terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def lookups(held: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """item, rare, at, next, next_at: the rarest and second rarest term of every window and their places in the item.

    A window of one word has no second term.  Windows that share both share a row.
    """
    size = F.col("size")
    tokens = held.select("item", F.size("phrase").alias("size"), F.posexplode("phrase").alias("place", "term")).join(counts, "term")
    # Every token goes to the windows that hold it, so a row never holds more than a window, however long the item.
    starts = F.sequence(F.greatest(F.col("place") - window + 1, F.lit(0)), F.least(F.col("place"), F.greatest(size - window, F.lit(0))))
    each = tokens.select("item", F.struct("n", "term", "place").alias("t"), F.explode(starts).alias("s"))
    best = each.groupBy("item", "s").agg(F.slice(F.array_sort(F.collect_list("t")), 1, 2).alias("b"))
    second = F.try_element_at("b", F.lit(2))
    return best.select("item", F.col("b")[0]["term"].alias("rare"), F.col("b")[0]["place"].alias("at"), second["term"].alias("next"), second["place"].alias("next_at")).distinct()


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, doc, pos: the stored postings of ``terms`` in all documents, positions counted in words from 0."""
    tokens = docs.select("doc", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return stage(tokens.join(terms, "term", "left_semi").select("term", "doc", "pos"), "postings")


def alignments(index: DataFrame, asked: DataFrame) -> DataFrame:
    """item, doc, shift: where a window's two rarest terms stand at their distance; shift is the item's first word's position."""
    first = asked.join(index, asked["rare"] == index["term"]).select("item", "doc", (F.col("pos") - F.col("at")).alias("shift"), "next", "next_at")
    alone = first.where("next is null").select("item", "doc", "shift")
    pairs = first.where("next is not null").withColumn("want", F.col("shift") + F.col("next_at"))
    other = index.select(F.col("term").alias("_term"), F.col("doc").alias("_doc"), F.col("pos").alias("_pos"))
    met = pairs.join(other, (F.col("doc") == F.col("_doc")) & (F.col("want") == F.col("_pos")) & (F.col("next") == F.col("_term")), "left_semi")
    return alone.unionByName(met.select("item", "doc", "shift")).distinct()


def _hits(text_words: Column, phrase: Column, shift: Column, window: int) -> Column:
    """The word positions that whole windows of one aligned phrase cover."""
    size = F.least(F.lit(window), F.size(phrase))
    same = F.transform(phrase, lambda w, j: F.coalesce((shift + j >= 0) & (F.get(text_words, shift + j) == w), F.lit(False)))
    # As a variable, the comparison is made once for all windows.
    starts = lambda held: F.filter(F.sequence(F.lit(0), F.size(phrase) - size), lambda s: F.forall(F.slice(held, s + 1, size), lambda x: x))
    found = F.flatten(F.transform(F.array(same), starts))
    return F.flatten(F.transform(found, lambda s: F.sequence((shift + s).cast("int"), (shift + s + size - 1).cast("int"))))


def indexed(docs: DataFrame, items: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The phrases of ``items``, the lookups of their windows, and the index of the terms that these ask for."""
    held = stage(phrases(items), "phrases")
    counts = stage(term_counts(docs, held.select(F.explode("phrase").alias("term")).distinct()), "term-counts")
    asked = stage(lookups(held, counts, window), "lookups")
    terms = asked.select(F.col("rare").alias("term")).unionByName(asked.where("next is not null").select(F.col("next").alias("term"))).distinct()
    return held, asked, build_index(docs, terms)


def exact(docs: DataFrame, held: DataFrame, asked: DataFrame, index: DataFrame, window: int) -> DataFrame:
    """doc, mark, hits, items, as ``contaminated`` returns them."""
    aligned = alignments(index, asked).groupBy("doc", "item").agg(F.collect_list("shift").alias("shifts"))
    whole = aligned.join(held, "item").select("doc", F.struct("name", "phrase", "shifts").alias("found"))
    # A document's alignments are bounded by its own words and the items; the text joins once, for documents that have any.
    lists = stage(whole.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list("found").alias("found")), "alignments")
    joined = docs.join(lists, F.col("doc") == F.col("_doc")).select("doc", F.xxhash64("text").alias("mark"), words(F.col("text")).alias("ws"), "found")
    joined = stage(joined, "aligned-words")  # else a text would be split anew for every word that is compared
    of = lambda f: F.flatten(F.transform(f["shifts"], lambda s: _hits(F.col("ws"), f["phrase"], s, window)))
    each = F.transform("found", lambda f: F.struct(f["name"].alias("name"), of(f).alias("hits")))
    judged = joined.select("doc", "mark", F.filter(each, lambda f: F.size(f["hits"]) > 0).alias("found")).where(F.size("found") > 0)
    judged = judged.select("doc", "mark", F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda f: f["hits"])))).alias("hits"), F.array_sort(F.array_distinct(F.transform("found", lambda f: f["name"]))).alias("items"))
    return judged.distinct()


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, mark, hits, items: documents in which whole windows of items occur, the word positions hit, and the items.

    ``mark`` tells apart rows that repeat an id with other texts; rows that
    repeat both give one row.  An item shorter than the window is one window;
    items without words, null or empty, match nothing.
    """
    docs = _documents(docs)
    return exact(docs, *indexed(docs, items, window), window)


def near(held: DataFrame, asked: DataFrame, index: DataFrame, slop: int) -> DataFrame:
    """doc, name, pos, gap, as ``proximity_matches`` describes them."""
    block = lambda c: F.floor(c / F.lit(slop + 1)).cast("bigint")
    asked = asked.where("next is not null")
    first = asked.join(index, asked["rare"] == index["term"]).select("item", "doc", "pos", (F.col("pos") - F.col("at") + F.col("next_at")).alias("want"), "next")
    first = first.withColumn("block", F.explode(F.array(*[block(F.col("want")) + d for d in (-1, 0, 1)])))
    other = index.select(F.col("term").alias("_term"), F.col("doc").alias("_doc"), F.col("pos").alias("_pos"), block(F.col("pos")).alias("_block"))
    met = first.join(other, (F.col("doc") == F.col("_doc")) & (F.col("block") == F.col("_block")) & (F.col("next") == F.col("_term")))
    gap = F.col("_pos") - F.col("want")
    close = met.where((F.abs(gap) <= slop) & (F.col("_pos") != F.col("pos"))).select("item", "doc", "pos", gap.alias("gap"))
    return close.join(held.select("item", "name"), "item").select("doc", "name", "pos", "gap").distinct()


def _own(doc: Column) -> Column:
    return F.when(doc != _NULL, doc)


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = SLOP, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, pos, gap: where a window's two rarest terms stand within ``slop`` words of their distance in the item.

    ``pos`` is the rarest term's position and ``gap`` the difference from the
    item's distance, 0 for a candidate of an exact match.  Positions meet in
    blocks of slop + 1 words, so a frequent term costs no pairs beyond its
    neighbourhood.  Windows of one word have no pair.  Rows that share an id,
    or have none, count as one document.
    """
    docs = _documents(docs)
    found = near(*indexed(docs, items, window), slop)
    return found.select(_own(F.col("doc")).alias("doc_id"), F.col("name").alias("item_id"), "pos", "gap")


def judge(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """doc_id, n_words, hits, items, n_near: every document with the positions of its words inside occurring windows, the items, and its proximity matches.

    ``n_near`` counts matches at another distance than the item's (see
    ``proximity_matches``).  One row for each input row; null, empty and
    wordless texts have no words and no hits.  Other columns are left out.
    """
    docs = _documents(docs)
    held, asked, index = indexed(docs, items, window)
    found = exact(docs, held, asked, index, window).withColumnsRenamed({"doc": "_doc", "mark": "_mark"})
    close = near(held, asked, index, slop).where("gap <> 0").groupBy(F.col("doc").alias("_near")).agg(F.count(F.lit(1)).alias("n_near"))
    every = docs.select("doc", F.xxhash64("text").alias("mark"), F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    out = every.join(found, (F.col("doc") == F.col("_doc")) & (F.col("mark") == F.col("_mark")), "left").join(close, F.col("doc") == F.col("_near"), "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return out.select(_own(F.col("doc")).alias("doc_id"), "n_words", none("hits", "int"), none("items", "string"), F.coalesce("n_near", F.lit(0)).alias("n_near"))


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no window of an item occurs, in the columns of documents.

    Null, empty and wordless texts stay; rows of equal id and text stay or go
    together, other rows of an id, or without one, are judged by themselves.
    """
    whole = pick(docs, "doc_id", "text", "lang", "source", "n_chars")
    gone = contaminated(docs, items, window).select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark"))
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL))
    return whole.join(gone, (key == F.col("_doc")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_mark")), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit, n_items = F.size("hits").cast("bigint"), F.size("items").cast("bigint")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "n_near")


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (
  SELECT doc_id, {_SQL_WORDS} AS ws FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item_id, {_SQL_WORDS} AS ws FROM benchmark
), bw AS (
  SELECT item_id, least(len(ws), {WINDOW}) AS n, array_to_string(ws[s:s + least(len(ws), {WINDOW}) - 1], ' ') AS w
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) AS s FROM b WHERE len(ws) > 0)
), sizes AS (
  SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, sizes WHERE len(ws) >= n)
), hit AS (
  SELECT DISTINCT doc_id, dw.n, s, item_id FROM dw JOIN bw ON dw.w = bw.w AND dw.n = bw.n
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
), tokens AS (
  SELECT doc_id, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS pos FROM d
), places AS (
  SELECT item_id, ws, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS place FROM (SELECT DISTINCT item_id, ws FROM b WHERE len(ws) > 0)
), counts AS (
  SELECT term, count(*) AS n FROM tokens WHERE term IN (SELECT term FROM places) GROUP BY term
), ranked AS (
  SELECT item_id, ws, s, p.term, place, row_number() OVER (PARTITION BY item_id, ws, s ORDER BY coalesce(n, 0), p.term, place) AS r
  FROM (SELECT *, unnest(range(greatest(0, place - {WINDOW - 1}), least(place, greatest(len(ws) - {WINDOW}, 0)) + 1)) AS s FROM places) p
  LEFT JOIN counts USING (term)
), asked AS (
  SELECT DISTINCT x.item_id, x.ws, x.term AS rare, x.place AS rare_at, y.term AS next, y.place AS next_at
  FROM ranked x JOIN ranked y ON x.item_id = y.item_id AND x.ws = y.ws AND x.s = y.s AND x.r = 1 AND y.r = 2
), near AS (
  SELECT DISTINCT x.doc_id, item_id, x.pos, y.pos - (x.pos - rare_at + next_at) AS gap
  FROM asked JOIN tokens x ON x.term = rare JOIN tokens y ON y.doc_id = x.doc_id AND y.term = next AND y.pos <> x.pos
  WHERE abs(y.pos - (x.pos - rare_at + next_at)) <= {SLOP} AND y.pos <> x.pos - rare_at + next_at
), close AS (
  SELECT doc_id, count(*) AS n_near FROM near GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN close USING (doc_id)
"""
