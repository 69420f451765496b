"""Where windows of whole documents may repeat: winnowed anchors that occur at least twice, dealt to shards by bytes.

Every window of a fixed length is anchored at one of its k-grams, chosen by the
window's content alone, so equal windows have equal anchors wherever they
stand.  An anchor that occurs once covers no window that repeats; the stretches
around all others go to shards, in which the operators compare them.

Nothing here gathers a hot anchor.  A task that holds one twice knows that it
repeats: it sends those rows on without their meeting any others, and one
witness for the tasks that hold it once.  Anchors with more text than a shard
should hold are dealt over several shards, and what these keep as first is
merged afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._base import pick, release, stage

#: A null id travels as the least integer.
NULL_ID = -(1 << 63)
#: Rows that a task gathers before it sends them.
HELD = 400_000
#: Input bytes on disk for each bucket.
BUCKET_BYTES = 8 << 20
#: Bytes of an Arrow batch of texts, which a worker holds in several forms at once.
BATCH_BYTES = 8 << 20

Rows = dict[str, np.ndarray]
Fields = tuple[tuple[str, type], ...]
#: The windows that start at first..first + span share an anchor, which begins ``at`` units after first.
ANCHORS: Fields = (("h", np.uint64), ("doc", np.int64), ("first", np.int32), ("span", np.int16), ("at", np.int16))
_LONE, _WITNESS, _TOLD = 0, 1, 2


def ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def twins(keys: np.ndarray) -> np.ndarray:
    """Which of these keys occur more than once."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def anchor_rows(h: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray) -> Rows:
    return {"h": h, "doc": doc, "first": first, "span": last - first, "at": at - first}


#: How a field travels: numpy's type, Arrow's and Spark's.
_KINDS = {np.uint64: (pa.int64(), "bigint"), np.int64: (pa.int64(), "bigint"), np.int32: (pa.int32(), "int"), np.int16: (pa.int16(), "smallint")}


def repeated(df: DataFrame, produce: Callable[[pa.RecordBatch], Iterator[Rows]], fields: Fields, n_buckets: int) -> DataFrame:
    """The rows that ``produce`` finds in each batch whose first field occurs in at least two of them, as columns of these fields.

    A task sends each value of that field to its bucket once for every HELD
    rows, however often it occurs; the second field spreads what needs no meeting.
    """
    key, spread = fields[0][0], fields[1][0]
    packed_schema = pa.schema([("bucket", pa.int32()), *[(n, pa.binary()) for n, _ in fields], ("kind", pa.binary())])
    out_schema = pa.schema([(n, _KINDS[t][0]) for n, t in fields])

    def sent(parts: list[Rows]) -> pa.RecordBatch:
        rows = {n: np.concatenate([p[n] for p in parts]) for n, _ in fields}
        told = twins(rows[key])
        _, one = np.unique(rows[key][told], return_index=True)
        witness = np.flatnonzero(told)[one]
        index = np.concatenate([np.arange(len(told)), witness])
        kind = np.concatenate([np.where(told, _TOLD, _LONE), np.full(len(witness), _WITNESS)]).astype(np.uint8)
        by = np.where(kind == _TOLD, A.mix(rows[spread][index].view(np.uint64)), rows[key][index])
        bucket = ((by >> np.uint64(24)) % np.uint64(n_buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, index, kind = bucket[order], index[order], kind[order]
        cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        packed = [pa.array([v[a:b].tobytes() for a, b in spans], pa.binary()) for v in (*[rows[n][index] for n, _ in fields], kind)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]], pa.int32()), *packed], schema=packed_schema)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[Rows] = []
        size = 0
        for batch in batches:
            for rows in produce(batch) if batch.num_rows else ():
                parts.append({n: np.ascontiguousarray(rows[n], dtype=t) for n, t in fields})
                size += len(rows[key])
                if size >= HELD:
                    yield sent(parts)
                    parts, size = [], 0
        if size:
            yield sent(parts)

    def meet(dealt: pa.Table) -> pa.Table:
        rows = {n: np.frombuffer(b"".join(dealt.column(n).to_pylist()), t) for n, t in (*fields, ("kind", np.uint8))}
        here = np.flatnonzero(rows["kind"] != _TOLD)
        met = here[twins(rows[key][here])]
        keep = np.concatenate([np.flatnonzero(rows["kind"] == _TOLD), met[rows["kind"][met] == _LONE]])
        return pa.table([pa.array(rows[n][keep].view(np.int64) if t is np.uint64 else rows[n][keep]) for n, t in fields], schema=out_schema)

    packed = df.mapInArrow(deal, "bucket int, " + ", ".join(f"{n} binary" for n, _ in fields) + ", kind binary")
    return packed.groupBy("bucket").applyInArrow(meet, ", ".join(f"{n} {_KINDS[t][1]}" for n, t in fields))


def text_of(docs: DataFrame, *more: str) -> DataFrame:
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    kept = pick(docs, "doc_id", "text", *more)
    return kept.withColumns({"doc_id": F.col("doc_id").cast("bigint"), "text": F.col("text").cast("string")})


def keyed(docs: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, text, _own, more: documents whose ``doc_id`` tells different rows apart, and their own id as ``_own``; and doc_id, text without repeats.

    Ids that are there and unique stay as they are.  Else rows get numbers in
    the order of (id, digest of the text), null ids first, so a smaller id
    still has a smaller number; rows of equal id and text share one.
    """
    texts = text_of(docs, *more)
    if texts.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        return texts.withColumn("_own", F.col("doc_id")), texts.select("doc_id", "text")
    pairs = texts.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_d")).distinct().repartitionByRange("_id", "_d").sortWithinPartitions("_id", "_d")
    numbers = stage(pairs.withColumn("_row", F.monotonically_increasing_id()), "row-numbers")  # ranges are in order, so these numbers are
    found = texts.join(numbers, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_d")))
    found = found.select(F.col("_row").alias("doc_id"), "text", F.col("doc_id").alias("_own"), *more)
    return found, found.select("doc_id", "text").dropDuplicates(["doc_id"])


def in_shards(anchors: DataFrame, weight, shard_bytes: int) -> DataFrame:
    """The rows with ``part`` and ``wide``: an anchor of more than ``shard_bytes`` in all is dealt over several parts, by document and place."""
    heavy = anchors.groupBy("h").agg(F.sum(weight).alias("n")).where(F.col("n") > shard_bytes)
    heavy = stage(heavy.select(F.col("h").alias("_h"), F.ceil(F.col("n") / shard_bytes).cast("int").alias("_parts")), "heavy-anchors")
    # At most one heavy anchor for each shard_bytes of text: Spark broadcasts them while they are small, and splits hot keys beyond.
    rows = anchors.join(heavy, F.col("h") == F.col("_h"), "left")
    part = F.pmod(F.xxhash64("doc", "first"), F.coalesce("_parts", F.lit(1))).cast("int")
    return rows.select("h", "doc", "first", "span", "at", part.alias("part"), F.col("_parts").isNotNull().alias("wide"))


def by_document(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """One row per document with the list of its windows; a document's list is bounded by its own length."""
    return rows.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct(*columns)).alias(name))


def stream_shards(sort: Callable[[pa.Table], pa.Table], size_of: str, shard_bytes: int):
    """A mapInArrow function over rows in order of (h, part): ``sort`` gets whole parts, about ``shard_bytes`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, part = batch.column("h").to_numpy(zero_copy_only=False), batch.column("part").to_numpy(zero_copy_only=False)
            turn = np.append(True, (h[1:] != h[:-1]) | (part[1:] != part[:-1]))
            turn[0] = last is not None and (h[0], part[0]) != last
            last = (h[-1], part[-1])
            weight = np.cumsum(pa.compute.binary_length(batch.column(size_of)).to_numpy(zero_copy_only=False).astype(np.int64))
            begin = 0
            for at in np.flatnonzero(turn):
                here = weight[at - 1] if at else 0
                before = weight[begin - 1] if begin else 0
                if size + here - before >= shard_bytes:
                    held.append(pa.Table.from_batches([batch.slice(begin, at - begin)]))
                    yield from sort(pa.concat_tables(held)).to_batches()
                    held, size, begin = [], 0, int(at)
            held.append(pa.Table.from_batches([batch.slice(begin)]))
            size += int(weight[-1] - (weight[begin - 1] if begin else 0))
        if held:
            yield from sort(pa.concat_tables(held)).to_batches()

    return run


def spans(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of windows as runs (document, first, last)."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1))[: len(doc)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], start[last[: len(first)]]


FOUND = "doc bigint, first int, last int, shard bigint, d bigint, merge boolean"
_FOUND = pa.schema([("doc", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("shard", pa.int64()), ("d", pa.int64()), ("merge", pa.bool_())])


def found(doc, first, last, shard=None, d=None) -> pa.Table:
    """Removed runs of windows; or, with shard and digest, windows that a shard keeps and others may too."""
    n = len(doc)
    blank = np.zeros(n, np.int64)
    return pa.table(
        [pa.array(doc, pa.int64()), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(blank if shard is None else shard), pa.array(blank if d is None else d.view(np.int64)), pa.array(np.full(n, d is not None))],
        schema=_FOUND,
    )


def merge_shards(whole_first_document: bool):
    """An applyInArrow function: of windows that several shards keep, all but the earliest.

    Each shard's windows form a sorted run.  Runs are merged one after another:
    binary search finds every window of a run in what has been merged so far.
    With ``whole_first_document`` all windows of the earliest document stay.
    """

    def run(rows: pa.Table) -> pa.Table:
        shard, doc, start = (rows.column(c).to_numpy() for c in ("shard", "doc", "first"))
        key = rows.column("d").to_numpy().view(np.uint64)
        place = np.zeros(len(doc), np.int64) if whole_first_document else start.astype(np.int64)
        best = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))  # the earliest of each window so far
        for s in np.unique(shard):
            mine = np.flatnonzero(shard == s)
            mine = mine[np.lexsort((place[mine], doc[mine], key[mine]))]
            mine = mine[np.append(True, key[mine][1:] != key[mine][:-1])]
            k, d, p = key[mine], doc[mine], place[mine]
            at = np.searchsorted(best[0], k)
            met = np.zeros(len(k), bool)
            inside = at < len(best[0])
            met[inside] = best[0][at[inside]] == k[inside]
            old = at[met]
            earlier = (d[met] < best[1][old]) | ((d[met] == best[1][old]) & (p[met] < best[2][old]))
            best[1][old[earlier]], best[2][old[earlier]] = d[met][earlier], p[met][earlier]
            best = tuple(np.insert(b, at[~met], v[~met]) for b, v in zip(best, (k, d, p), strict=True))
        at = np.searchsorted(best[0], key)
        gone = (doc != best[1][at]) | (place != best[2][at])
        return found(*spans(doc[gone], start[gone].astype(np.int64)))

    return run


def compare(texts: DataFrame, produce, cut, sort, n_buckets: int, weight, size_of: str, pieces: str, shard_bytes: int, whole_first_document: bool, label: str) -> DataFrame:
    """doc, first, last: windows that also start earlier, decided in shards of all stretches whose anchors repeat.

    ``texts`` has unique ids.  ``cut`` (mapInArrow) takes documents with the
    list of their stretches to rows of ``pieces``; ``sort`` decides a shard.
    """
    anchors = stage(repeated(texts, produce, ANCHORS, n_buckets), f"{label}-anchors")
    release(texts.sparkSession)
    total = anchors.agg(F.sum(weight)).first()[0] or 0  # one number
    tasks = int(max(2 * texts.sparkSession.sparkContext.defaultParallelism, total // (32 * shard_bytes)))

    def dealt() -> DataFrame:
        lists = by_document(in_shards(anchors, weight, shard_bytes), "open", "first", "span", "at", "h", "part", "wide")
        narrowed = texts.join(lists, F.col("doc_id") == F.col("_doc")).select("doc_id", "text", "open")
        return narrowed.mapInArrow(cut, pieces).repartition(tasks, "h", "part").sortWithinPartitions("h", "part")

    # No variable holds the plan, so its shuffles go before the next ones are written.
    decided = stage(dealt().mapInArrow(stream_shards(sort, size_of, shard_bytes), FOUND), f"{label}-shards")
    release(texts.sparkSession)
    ranges = int(max(8, total // shard_bytes))
    met = decided.where("merge").withColumn("_range", F.pmod("d", F.lit(ranges))).groupBy("_range").applyInArrow(merge_shards(whole_first_document), FOUND)
    return decided.where("not merge").select("doc", "first", "last").unionByName(met.select("doc", "first", "last"))


def flat(column: pa.Array, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """A list column of window structs as offsets and the named fields."""
    lengths = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    inner = column.flatten()
    return np.append(0, np.cumsum(lengths)).astype(np.int64), [inner.field(n).to_numpy(zero_copy_only=False) for n in names]
