"""Suffix-array deduplication: every byte covered by a long string that also starts earlier.

Winnowed anchors first narrow the text to stretches whose windows may repeat
(see ``_repeats``); all of them, copies included, are dealt to shards by their
anchor, so all that may be equal is in one shard.  Each shard sorts its suffixes
and compares neighbours (see ``_suffixes``).  An anchor with more text than a
shard should hold is dealt over several; what such shards keep as first is then
merged across shards by binary search.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _arrays as A
from . import _repeats as R
from ._base import buckets, table
from ._suffixes import equal_windows

WINDOW = 100
#: Bytes in an anchor's gram: with windows of 100 bytes about every 39th byte is an anchor.
GRAM = 24
#: Bytes of text in a shard; sorting takes about a hundred bytes of memory for each.
SHARD_BYTES = 1 << 20

PIECES = "h bigint, part int, wide boolean, doc bigint, first int, bytes binary"


def anchors(window: int, gram: int):
    def produce(batch: pa.RecordBatch) -> Iterator[R.Rows]:
        docs = R.ids(batch.column(0))
        for first, _, data, offsets in A.pieces(batch.column(1)):
            if len(data) < window:
                continue
            grams = A.byte_grams(data, gram)
            doc, begin, last, anchor = A.winnow(grams, offsets, window, gram)
            if len(doc):
                start = offsets[doc]
                yield R.anchor_rows(grams[anchor], docs[first + doc], begin - start, last - start, anchor - start)

    return produce


def _stretches(window: int):
    """The bytes of every listed stretch of a document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = R.ids(batch.column(0))
            lists, (first, span, h, part, wide) = R.flat(batch.column(2), "first", "span", "h", "part", "wide")
            for begin, end, data, offsets in A.pieces(batch.column(1)):
                a, b = lists[begin], lists[end]
                row = np.repeat(np.arange(end - begin), np.diff(lists[begin : end + 1]))
                size = span[a:b].astype(np.int64) + window
                cuts = np.append(0, np.cumsum(size))
                at = np.repeat(offsets[row] + first[a:b] - cuts[:-1], size) + np.arange(cuts[-1])
                raw = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data[at])])
                yield pa.RecordBatch.from_arrays([pa.array(h[a:b]), pa.array(part[a:b]), pa.array(wide[a:b]), pa.array(docs[begin + row]), pa.array(first[a:b]), raw], names=["h", "part", "wide", "doc", "first", "bytes"])

    return cut


def sort_shard(window: int):
    """Of a shard's rows: the removed windows, and the firsts that still have to meet other shards'."""

    def run(rows: pa.Table) -> pa.Table:
        # Pieces of equal bytes stand in the suffix array once, with as many places.
        number: dict[bytes, int] = {}
        copy_of = np.array([number.setdefault(x, len(number)) for x in rows.column("bytes").to_pylist()], np.int64)
        data = np.frombuffer(b"".join(number), np.uint8)
        sizes = np.array([len(x) for x in number], np.int64)
        edges = np.append(0, np.cumsum(sizes))
        piece = np.repeat(np.arange(len(sizes)), sizes)
        at, group = equal_windows(data, edges[1:][piece], window)
        order = np.argsort(at)
        at, group = at[order], group[order]
        # Every window of every place, with the number of its group.
        own = np.searchsorted(at, edges)
        n = np.diff(own)[copy_of]
        of = np.repeat(np.arange(len(copy_of)), n)
        index = own[copy_of][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        at, group = at[index], group[index]
        wide = rows.column("wide").to_numpy()
        meets = (np.bincount(group)[group] > 1) | wide[of]
        at, group, of = at[meets], group[meets], of[meets]
        doc = rows.column("doc").to_numpy()[of]
        start = at + (rows.column("first").to_numpy() - edges[copy_of])[of]
        order = np.lexsort((start, doc, group))
        new = np.append(True, group[order][1:] != group[order][:-1])[: len(order)]
        firsts, rest = order[new], order[~new]
        out = [R.found(*R.spans(doc[rest], start[rest]))]
        firsts = firsts[wide[of[firsts]]]
        if len(firsts):
            h, part = rows.column("h").to_numpy().view(np.uint64)[of[firsts]], rows.column("part").to_numpy()[of[firsts]]
            digest = A.byte_spans(data, at[firsts], at[firsts] + window) ^ A.mix(h)
            shard = (A.mix(h) ^ part.astype(np.uint64)).view(np.int64)
            out.append(R.found(doc[firsts], start[firsts], start[firsts], shard, digest))
        return pa.concat_tables(out)

    return run


def repeats(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc, first, last: starts first..last of ``window``-byte strings that also start earlier.

    Earlier is a smaller doc_id, or the same document at an earlier byte.
    Strings are of the UTF-8 bytes of whole texts and never cross documents;
    null and empty texts have none.  ``texts`` (doc_id, text) has unique ids:
    ``_repeats.keyed`` gives rows numbers where they aren't.
    """
    weight = F.col("span").cast("bigint") + window
    return R.compare(texts, anchors(window, gram), _stretches(window), sort_shard(window), buckets(texts, R.BUCKET_BYTES), weight, "bytes", PIECES, shard_bytes, False, "byte")


def cut_spans(raw: bytes, cuts: list | None, window: int) -> list[tuple[int, int]]:
    """The maximal removed spans of a text, by byte."""
    if not cuts:
        return []
    low = np.array([c["first"] for c in cuts])
    high = np.minimum(np.array([c["last"] for c in cuts]) + window, len(raw))
    fits = low < high
    a, b = A.runs(low[fits], high[fits])
    return list(zip(a.tolist(), b.tolist(), strict=True))


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    if not spans:
        return raw
    edges = [0, *[x for s in spans for x in s], len(raw)]
    return b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))


REMOVED = "doc_id bigint, n_bytes bigint, spans array<struct<first:int,last:int>>, kept binary"


def _with_cuts(docs: DataFrame, window: int, *more: str) -> DataFrame:
    keyed, each = R.keyed(docs, *more)
    lists = R.by_document(repeats(each, window), "cuts", "first", "last")
    return keyed.join(lists, F.col("doc_id") == F.col("_doc"), "left").select(F.col("_own").alias("doc_id"), "text", "cuts", *more)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, spans, kept: removed spans (first byte, byte after the last) and the bytes that stay, for every document.

    One row for each input row; null and empty texts have no bytes.  Rows of
    equal id and text are one document and lose the same bytes; other rows that
    share an id, or have none, are documents of their own.  What stays
    is bytes, as a span may begin or end inside a character.  Other columns
    are left out.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [(t or "").encode("utf-8") for t in batch.column(1).to_pylist()]
            spans = [cut_spans(r, c, window) for r, c in zip(raws, batch.column(2).to_pylist(), strict=True)]
            kept = [kept_bytes(r, s) for r, s in zip(raws, spans, strict=True)]
            pairs = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(r) for r in raws], pa.int64()), pa.array([[{"first": a, "last": b} for a, b in s] for s in spans], pairs), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    return _with_cuts(docs, window).mapInArrow(cut, REMOVED)


def clean_documents(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with repeated bytes taken out of their texts, in the columns of documents.

    Characters that lose a byte go as a whole; n_chars is counted again.  A
    text that was null stays null.  Every document stays, even if empty.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8")
                spans = cut_spans(raw, cuts, window)
                edges = [0, *[x for s in spans for x in s], len(raw)]
                texts.append(text if not spans else "".join(raw[edges[i] : edges[i + 1]].decode("utf-8", "ignore") for i in range(0, len(edges), 2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), batch.column(3), batch.column(4), pa.array([None if t is None else len(t) for t in texts], pa.int64())], names=["doc_id", "text", "lang", "source", "n_chars"]
            )

    joined = _with_cuts(docs, window, "lang", "source").withColumns({c: F.col(c).cast("string") for c in ("lang", "source")})
    return joined.mapInArrow(cut, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"])
    return kept.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes stand as pairs of hex digits; texts are cut into blocks first, so that no window is sought from the start of a long text.
SQL = f"""
WITH raw AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), blocks AS (
  SELECT doc_id, x, unnest(range(0, length(x) // 2, 1000)) AS b FROM raw
), pieces AS (
  SELECT doc_id, b, substring(x, 2 * b + 1, 2 * {999 + WINDOW}) AS piece FROM blocks
), starts AS (
  SELECT doc_id, b, piece, unnest(range(0, least(1000, length(piece) // 2 - {WINDOW - 1}))) AS i FROM pieces
), ranked AS (
  SELECT doc_id, b + i AS s, row_number() OVER (PARTITION BY md5(substring(piece, 2 * i + 1, {2 * WINDOW})) ORDER BY doc_id, b + i) AS nth FROM starts
), later AS (
  SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {WINDOW} THEN 0 ELSE 1 END AS fresh FROM ranked WHERE nth > 1
), numbered AS (
  SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM later
), spans AS (
  SELECT doc_id, min(s) AS lo, max(s) + {WINDOW} AS hi FROM numbered GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS z FROM spans
  UNION ALL
  SELECT doc_id, max(hi), NULL FROM spans GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(substring(x, 2 * a + 1, 2 * (coalesce(z, length(x) // 2) - a)), '' ORDER BY a) AS left_over FROM gaps JOIN raw USING (doc_id) GROUP BY doc_id
), sums AS (
  SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(left_over, x))) AS kept_sha256
FROM raw LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
