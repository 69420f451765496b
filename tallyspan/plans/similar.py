"""Families of copies and repeated runs over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lean, sequences
from ..operators import similar as S
from . import query


@query("""
WITH f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS family, count(*) OVER (PARTITION BY text) AS size FROM documents)
SELECT doc_id, family, size FROM f WHERE size > 1
""")
def exact_families(read):
    """Documents of equal text."""
    return S.exact_families(read("documents"), "doc_id", F.col("text"))


# Texts as multisets of five-word shingles; a text of fewer words is one shingle.
_NEAR = """
heads AS (SELECT min(doc_id) AS k, text FROM documents WHERE text IS NOT NULL GROUP BY text
), ws AS (SELECT k, string_split(lower(text), ' ') AS ws FROM heads
), sets AS (SELECT k, t, count(*) AS c FROM (SELECT k, unnest([array_to_string(ws[i:i + 4], ' ') for i in range(1, greatest(len(ws) - 4, 1) + 1)]) AS t FROM ws) GROUP BY ALL
), sizes AS (SELECT k, sum(c) AS n FROM sets GROUP BY k
), shared AS (SELECT x.k AS a, y.k AS b, sum(least(x.c, y.c)) AS s FROM sets x JOIN sets y ON x.t = y.t AND x.k < y.k GROUP BY ALL
), pairs AS (SELECT a, b, (s * 20000 // (p.n + q.n))::BIGINT AS bp FROM shared JOIN sizes p ON p.k = a JOIN sizes q ON q.k = b WHERE s * 20000 // (p.n + q.n) >= 8000)
"""


def _shingles(text):
    of = lambda ws: F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - 5, F.lit(0))), lambda i: F.array_join(F.slice(ws, i + 1, 5), " "))
    return F.flatten(F.transform(F.array(F.split(F.lower(text), " ")), of))  # as a variable, a text's words are split once


@query(f"""
WITH RECURSIVE {_NEAR}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), r AS (SELECT k AS node, k AS other FROM heads UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a
), part AS (SELECT node, min(other) AS family FROM r GROUP BY node), named AS (SELECT doc_id, family FROM documents JOIN heads USING (text) JOIN part ON node = k), f AS (SELECT *, count(*) OVER (PARTITION BY family) AS size FROM named)
SELECT doc_id, family, size FROM f WHERE size > 1
""")
def near_families(read):
    """Families of near copies among all documents, by shingles of five words."""
    return S.near_families(read("documents"), "doc_id", F.col("text"), _shingles(F.col("text")), 8000)


@query(f"WITH {_NEAR} SELECT a, b, bp FROM pairs")
def near_pairs(read):
    """Pairs of all texts, one of each exact family, with their similarity in parts of ten thousand."""
    return S.near_pairs(read("documents"), "doc_id", _shingles(F.col("text")), 8000, F.col("text"))


# Runs grow line by line while they stand elsewhere; the longest from each place is kept if no other site of it has the same line before.
@query("""
WITH RECURSIVE lines AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS i, unnest(ls) AS text FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM documents WHERE text <> '')
), runs AS (
  SELECT doc_id, i, 1 AS n, md5(text) AS h FROM (SELECT *, count(*) OVER (PARTITION BY text) AS c FROM lines) WHERE c > 1
  UNION ALL
  SELECT doc_id, i, n, h FROM (SELECT r.doc_id, r.i, r.n + 1 AS n, md5(r.h || md5(l.text)) AS h, count(*) OVER (PARTITION BY md5(r.h || md5(l.text))) AS c FROM runs r JOIN lines l ON l.doc_id = r.doc_id AND l.i = r.i + r.n) WHERE c > 1
), longest AS (SELECT doc_id, i, max(n) AS n, arg_max(h, n) AS h FROM runs GROUP BY ALL HAVING max(n) >= 3
), sites AS (SELECT g.doc_id, g.i, g.n, count(*) AS sites, count(*) FILTER (b.text = a.text) AS same FROM longest g JOIN runs r ON r.h = g.h AND r.n = g.n
  LEFT JOIN lines a ON a.doc_id = g.doc_id AND a.i = g.i - 1 LEFT JOIN lines b ON b.doc_id = r.doc_id AND b.i = r.i - 1 GROUP BY ALL)
SELECT doc_id, i::INT AS first, n::INT AS lines, sites FROM sites WHERE same <= 1
""")
def repeated_runs(read):
    """Stretches of three and more lines that documents repeat."""
    rows = sequences.lines(read("documents"), "doc_id", "text")
    return S.repeated_runs(rows, "doc_id", "line", F.col("text"))


@query(None)
def lean_report(read):
    """Lines that merging repeated stretches would remove from each document; the most saving merge first, none sharing a line."""
    rows = sequences.lines(read("documents"), "doc_id", "text")
    return lean.report(lean.merges(rows, "doc_id", "line", F.col("text")), "doc_id")
