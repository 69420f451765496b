"""Substring deduplication over words: seed on winnowed anchors, extend both ways, keep maximal repeats.

Seeds are the winnowed k-grams of every document.  Documents that share a seed
meet in a shard (see ``_repeats``), each with the words around it, and their
matches are extended to the left and to the right, by halves of what a window
holds beyond its seed.  Matches are held as groups of places that agree so far,
never as pairs: each step splits a group by the words it reaches, and a place
that agrees with no other any more drops out.  What has grown to the threshold
is a repeat of the earliest document in its group; repeats that touch join to
maximal ones.
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

WINDOW = 50
#: Words in a seed: with windows of 50 words about every 21st word starts one.
SEED = 10
#: Bytes of word digests in a shard, 8 for each word around a seed.
SHARD_BYTES = 2 << 20

PIECES = "h bigint, part int, wide boolean, doc bigint, first int, at smallint, words binary"


def _sequences(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The words of runs of documents: the first and last document, the offsets of each one's words, and the words' digests."""
    for first, last, data, offsets in A.pieces(texts):
        starts, ends, of = A.words(data, offsets)
        yield first, last, of, A.byte_spans(data, starts, ends)


def seeds(window: int, seed: int):
    def produce(batch: pa.RecordBatch) -> Iterator[R.Rows]:
        docs = R.ids(batch.column(0))
        for first, _, of, digests in _sequences(batch.column(1)):
            if of[-1] < window:
                continue
            grams = A.Digests(digests).grams(seed)
            doc, begin, last, anchor = A.winnow(grams, of, window, seed)
            if len(doc):
                start = of[doc]
                yield R.anchor_rows(grams[anchor], docs[first + doc], begin - start, last - start, anchor - start)

    return produce


def _around(window: int):
    """The digests of the words around every listed seed of a document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = R.ids(batch.column(0))
            lists, (first, span, at, h, part, wide) = R.flat(batch.column(2), "first", "span", "at", "h", "part", "wide")
            for begin, end, of, digests in _sequences(batch.column(1)):
                a, b = lists[begin], lists[end]
                row = np.repeat(np.arange(end - begin), np.diff(lists[begin : end + 1]))
                size = span[a:b].astype(np.int64) + window
                cuts = np.append(0, np.cumsum(size))
                index = np.repeat(of[row] + first[a:b] - cuts[:-1], size) + np.arange(cuts[-1])
                raw = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((8 * cuts).astype(np.int32)), pa.py_buffer(digests[index])])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[a:b]), pa.array(part[a:b]), pa.array(wide[a:b]), pa.array(docs[begin + row]), pa.array(first[a:b]), pa.array(at[a:b]), raw], names=["h", "part", "wide", "doc", "first", "at", "words"]
                )

    return cut


def extended(words: np.ndarray, seat: np.ndarray, least: np.ndarray, most: np.ndarray, stay: np.ndarray, seed: int, rest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places whose match with others grows to a window: (place, words of the window left of the seed, key that equal windows share).

    ``seat`` is where each place's seed begins in ``words``; a window holds
    ``rest`` words besides, ``least`` to ``most`` of them on the left.  A match
    that has ``low`` words on the left and ``rest - high`` on the right may
    still become any window between; each step halves that range by extending
    one way or the other.  A place whose match has no other drops out, unless
    ``stay`` says that others stand elsewhere.
    """
    digests = A.Digests(words)
    place = np.arange(len(seat))
    low, high = np.zeros(len(seat), np.int64), np.full(len(seat), rest)
    while True:
        key = digests.spans(seat[place] - low, seat[place] + seed + rest - high) ^ A.mix((low * (rest + 1) + high + 1).astype(np.uint64))
        keep = (R.twins(key) | stay[place]) & (np.maximum(low, least[place]) <= np.minimum(high, most[place]))
        place, low, high, key = place[keep], low[keep], high[keep], key[keep]
        ranges = low < high
        if not ranges.any():
            return place, low, key
        middle = (low + high) // 2
        left = np.where(ranges, middle + 1, low)[ranges]
        place, low, high = np.concatenate([place, place[ranges]]), np.concatenate([low, left]), np.concatenate([np.where(ranges, middle, high), high[ranges]])
        fits = (low <= most[place]) & (high >= least[place])
        place, low, high = place[fits], low[fits], high[fits]


def extend_shard(window: int, seed: int):
    """Of a shard's seeds: the windows that repeat one of an earlier document, and the firsts that still have to meet other shards'."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        raw = rows.column("words").chunk(0)
        edges = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, raw.offset * 4).astype(np.int64)
        words = np.frombuffer(raw.buffers()[2], np.uint8)[edges[0] : edges[-1]].view(np.uint64)
        edges = (edges - edges[0]) // 8
        doc, first, at, h, part, wide = (rows.column(c).to_numpy() for c in ("doc", "first", "at", "h", "part", "wide"))
        own = at.astype(np.int64)
        least = own - (np.diff(edges) - window)
        place, left, key = extended(words, edges[:-1] + own, least, own, wide, seed, window - seed)
        d, start = doc[place], first[place] + own[place] - left
        order = np.lexsort((d, key))
        turn = np.append(True, key[order][1:] != key[order][:-1])[: len(order)]
        earliest = np.empty(len(order), np.int64)
        earliest[order] = d[order][turn][np.cumsum(turn) - 1] if len(order) else 0
        gone = d > earliest
        out = [R.found(*R.spans(d[gone], start[gone]))]
        firsts = np.flatnonzero(~gone & wide[place])
        if len(firsts):
            of = place[firsts]
            shard = (A.mix(h[of].view(np.uint64)) ^ part[of].astype(np.uint64)).view(np.int64)
            out.append(R.found(d[firsts], start[firsts], start[firsts], shard, key[firsts] ^ A.mix(h[of].view(np.uint64))))
        return pa.concat_tables(out)

    return run


def repeats(texts: DataFrame, window: int = WINDOW, seed: int = SEED, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc, first, last: windows of ``window`` words, by first word, whose words also start in a document with a smaller id.

    Windows first..last of a row all repeat.  Documents with fewer words than
    the window, null and empty texts have no windows.  ``texts`` (doc_id, text)
    has unique ids: ``_repeats.keyed`` gives rows numbers where they aren't.
    """
    weight = 8 * (F.col("span").cast("bigint") + window)
    return R.compare(texts, seeds(window, seed), _around(window), extend_shard(window, seed), buckets(texts, R.BUCKET_BYTES), weight, "words", PIECES, shard_bytes, True, "word")


def kept_words(text: str | None, cuts: list | None, window: int) -> tuple[int, int, list[bytes]]:
    """The words of a text, how many of them the cut windows cover, and the rest."""
    every = (text or "").encode("utf-8").split()
    if not cuts:
        return len(every), 0, every
    gone = np.zeros(len(every) + 1, np.int32)
    low = np.array([c["first"] for c in cuts])
    high = np.minimum(np.array([c["last"] for c in cuts]) + window, len(every))
    fits = low < high
    np.add.at(gone, low[fits], 1)
    np.add.at(gone, high[fits], -1)
    covered = np.cumsum(gone[:-1]) > 0
    return len(every), int(covered.sum()), [every[i] for i in np.flatnonzero(~covered)]


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, text: every document with its repeated passages taken out, words joined by one space.

    One row for each input row.  A document without repeats keeps its words
    too; null and empty texts become empty texts with no words.  Rows of equal
    id and text are one document; other rows that share an id, or have none,
    are documents of their own.  Other columns are left out.
    """
    keyed, each = R.keyed(docs)
    lists = R.by_document(repeats(each, window, seed), "cuts", "first", "last")
    joined = keyed.join(lists, F.col("doc_id") == F.col("_doc"), "left").select(F.col("_own").alias("doc_id"), "text", "cuts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [kept_words(t, c, window) for t, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([b" ".join(r[2]).decode("utf-8", "replace") for r in rows], pa.string())],
                names=["doc_id", "n_words", "n_removed", "text"],
            )

    return joined.mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(ws) - {WINDOW - 2})) AS s, ws FROM w WHERE len(ws) >= {WINDOW}
), windows AS (
  SELECT doc_id, s, md5(array_to_string(ws[s:s + {WINDOW - 1}], ' ')) AS h FROM starts
), firsts AS (
  SELECT h, min(doc_id) AS first_doc FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + {WINDOW})) AS p FROM windows JOIN firsts USING (h) WHERE first_doc < doc_id
), lists AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
), tokens AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w
), kept AS (
  SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.p) AS text FROM tokens t LEFT JOIN gone g ON t.doc_id = g.doc_id AND t.p = g.p
  WHERE g.p IS NULL GROUP BY t.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
