"""Near-duplicate documents by min-max hashing.

Every permutation of a document's shingles gives two values, its minimum and
its maximum, so a signature costs half the hash evaluations, and as the two are
negatively dependent its estimate of the Jaccard similarity is unbiased with
lower variance.  Bands of the signature deal documents to buckets.  Documents
with equal shingle sets collapse to one before that.  Candidates are confirmed
on the full sets:

1. each bucket links its members to its least member (a star, never all pairs);
2. where a bucket still holds several components, each member outside the
   largest tries the most similar signature of another component;
3. where it still does, the documents of such buckets are compared in blocks,
   each pair of different components that shares a bucket by its full sets, so
   that no link depends on a star's centre.  Only confirmed links leave a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _arrays as A
from . import _repeats as R
from ._base import buckets, pick, stage, table
from ._components import components

PERMUTATIONS = 128
#: Values in a band: 21 bands of minima and 21 of maxima; two sets at 0.8 share none with a chance below 1 in 300,000.
ROWS = 6
BANDS = 2 * (PERMUTATIONS // ROWS)
#: Standard errors by which a signature may fall short of the threshold before its pair is given up (a chance below 1e-9).
SLACK = 6.0

_odd = A.mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_TIMES = (_odd >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_FLIP = (_odd & np.uint64(0xFFFFFFFF)).astype(np.uint32)
_FOLD = A.mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of documents as (first document, offsets, digests): each one's distinct shingles in ascending order."""
    for first, last, data, offsets in A.pieces(texts):
        data = A.LOWER[data]
        starts, ends, of = A.words(data, offsets)
        of_words = A.byte_spans(data, starts, ends)
        n = np.diff(of)
        count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
        doc = np.repeat(np.arange(len(n)), count)
        within = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        begin = of[doc] + within
        values = _shingles(of_words, begin, np.minimum(begin + width, of[doc + 1]), width)
        order = np.lexsort((values, doc))
        doc, values = doc[order], values[order]
        new = np.append(True, (doc[1:] != doc[:-1]) | (values[1:] != values[:-1]))[: len(doc)]
        doc, values = doc[new], values[new]
        yield first, np.searchsorted(doc, np.arange(last - first + 1)), values


def _shingles(of_words: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """The digest of each run of up to ``width`` words."""
    out = A.mix((end - begin).astype(np.uint64))
    for j in range(width):
        here = np.flatnonzero(begin + j < end)
        if len(here) == len(out):
            out = A.joined(out, of_words[begin + j])
        else:
            out[here] = A.joined(out[here], of_words[begin[here] + j])
    return out


def signatures(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Minima then maxima of every nonempty set under each permutation, one row per set."""
    full = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(full), 2 * PERMUTATIONS), np.uint32)
    if len(full):
        short = (values >> np.uint64(32)).astype(np.uint32)
        for j in range(PERMUTATIONS):
            permuted = (short ^ _FLIP[j]) * _TIMES[j]
            out[:, j] = np.minimum.reduceat(permuted, full)
            out[:, PERMUTATIONS + j] = np.maximum.reduceat(permuted, full)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    used = PERMUTATIONS // ROWS * ROWS
    halves = [signature[:, h * PERMUTATIONS : h * PERMUTATIONS + used].reshape(len(signature), used // ROWS, ROWS) for h in (0, 1)]
    values = np.concatenate(halves, axis=1).astype(np.uint64)
    return A.mix((values * _FOLD).sum(axis=2, dtype=np.uint64) + A.mix(np.arange(1, BANDS + 1, dtype=np.uint64)))


SIGNED = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands binary, sketch binary"


def sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, offsets, values in shingle_sets(batch.column(1), width):
                n = np.diff(offsets)
                full = np.flatnonzero(n)
                signature = signatures(offsets, values)
                keys, sketch = bands(signature), (signature & np.uint32(255)).astype(np.uint8)
                mixed = A.mix(values + np.uint64(0x51ED270B))
                sums = np.append(np.uint64(0), np.cumsum(mixed, dtype=np.uint64))
                other = np.append(np.uint64(0), np.cumsum(A.mix(mixed), dtype=np.uint64))
                d1, d2 = ((s[offsets[1:]] - s[offsets[:-1]]).view(np.int64) for s in (sums, other))
                blank: list[bytes | None] = [None] * len(n)
                packed, flat = list(blank), list(blank)
                for i, d in enumerate(full):
                    packed[d], flat[d] = keys[i].tobytes(), sketch[i].tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(n)), pa.array(n), pa.array(d1), pa.array(d2), pa.array(packed, pa.binary()), pa.array(flat, pa.binary())], names=["doc_id", "n_shingles", "d1", "d2", "bands", "sketch"])

    return run


MEMBERS: R.Fields = (("key", np.uint64), ("node", np.int64), ("n", np.int64))


def _banded(batch: pa.RecordBatch) -> Iterator[R.Rows]:
    """A row for every band of every document; ``_repeats.repeated`` keeps those that share their bucket."""
    keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64)
    yield {"key": keys, "node": np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS), "n": np.repeat(batch.column(1).to_numpy(zero_copy_only=False), BANDS)}


def stars(members: DataFrame, percent: int) -> DataFrame:
    """Each bucket's members paired with its least one, where their sizes allow the threshold."""
    centre = members.groupBy("key").agg(F.min(F.struct("node", "n")).alias("c"))
    met = members.join(centre, "key").where("node > c.node")
    return met.where(_sizes(F.col("n"), F.col("c.n"), percent)).select(F.col("c.node").alias("a"), F.col("node").alias("b")).distinct()


def _sizes(x, y, percent: int):
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _across(percent: int):
    """An applyInArrow function over one bucket, or part of a large one: for each member outside its largest component, the most similar signature of another."""
    share = percent / 100
    floor = share - SLACK * float(np.sqrt(share * (1 - share) / (2 * PERMUTATIONS)))

    def run(rows: pa.Table) -> pa.Table:
        node, n, part = (rows.column(c).to_numpy() for c in ("node", "n", "component"))
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
        _, inverse, sizes = np.unique(part, return_inverse=True, return_counts=True)
        a, b = [], []
        for i in np.flatnonzero(inverse != np.argmax(sizes)):
            near = np.flatnonzero((part != part[i]) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * percent))
            if not len(near):
                continue
            alike = (sketch[near] == sketch[i]).mean(axis=1)
            best = int(np.argmax(alike))
            if alike[best] >= floor:
                a.append(min(node[i], node[near[best]]))
                b.append(max(node[i], node[near[best]]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


#: Documents in a block, and bytes of their sets; a group of more is compared block by block.
BLOCK, BLOCK_BYTES = 2000, 8 << 20


def best_partners(open_rows: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs worth confirming between components that share a bucket; of a bucket with many members, within parts of it."""
    heavy = open_rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("_parts")).where("_parts > 1")
    heavy = stage(heavy.withColumnRenamed("key", "_key"), "heavy-buckets")
    rows = open_rows.join(heavy, F.col("key") == F.col("_key"), "left").withColumn("part", F.pmod(F.xxhash64("node"), F.coalesce("_parts", F.lit(1))))
    rows = rows.join(sketches, F.col("node") == F.col("_n")).select("key", "part", "node", "n", "component", "sketch")
    return rows.groupBy("key", "part").applyInArrow(_across(percent), "a bigint, b bigint").distinct()


def _numbered(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle sets one after another, with small numbers for digests, and where each begins."""
    of_set = np.append(0, np.cumsum([len(x) // 8 for x in packed], dtype=np.int64))
    return np.unique(np.frombuffer(b"".join(packed), np.uint64), return_inverse=True)[1].astype(np.int32), of_set


def _blocks(percent: int):
    """An applyInArrow function over a pair of blocks: links between components, by the full sets of documents that share a bucket."""

    def run(rows: pa.Table) -> pa.Table:
        node, n, part, block = (rows.column(c).to_numpy() for c in ("node", "n", "component", "block"))
        flat, of_set = _numbered(rows.column("shingles").to_pylist())
        _, part = np.unique(part, return_inverse=True)
        keys = rows.column("keys").combine_chunks()
        owner = np.repeat(np.arange(len(node)), pa.compute.list_value_length(keys).to_numpy(zero_copy_only=False))
        key = keys.flatten().to_numpy()
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        bounds = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        mine: list[list[np.ndarray]] = [[] for _ in node]
        for o, k in zip(owner, of, strict=True):
            mine[o].append(owner[bounds[k] : bounds[k + 1]])
        one = rows.column("lo")[0].as_py() == rows.column("hi")[0].as_py()
        a, b = [], []
        size = np.diff(of_set)
        marked = np.zeros(int(flat.max()) + 1 if len(flat) else 0, bool)
        for i in range(len(node)):
            shares = np.zeros(len(node), bool)
            for members in mine[i]:
                shares[members] = True
            shares[: i + 1] = False
            near = np.flatnonzero(shares & (part != part[i]))
            near = near[(np.minimum(n[near], n[i]) * 100 >= np.maximum(n[near], n[i]) * percent)]
            if not one:
                near = near[block[near] != block[i]]
            if not len(near):
                continue
            own = flat[of_set[i] : of_set[i + 1]]
            marked[own] = True
            common = np.empty(len(near), np.int64)
            for k, j in enumerate(near):
                common[k] = np.count_nonzero(marked[flat[of_set[j] : of_set[j + 1]]])
            marked[own] = False
            for j in near[100 * common >= percent * (size[i] + size[near] - common)]:
                if part[j] != part[i]:
                    part[part == part[j]] = part[i]  # what this joins needs no other link
                    a.append(node[i])
                    b.append(node[j])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])

    return run


def rest(open_rows: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """u, v: the links that remain between components of documents that share a bucket.

    Documents whose buckets touch form a group; a group of more than ``block``,
    or of more bytes than BLOCK_BYTES, is dealt to pairs of blocks, so a task
    never holds more than two, and each document's set goes to as many tasks
    as its group has blocks.
    """
    star = open_rows.groupBy("key").agg(F.min("node").alias("centre"))
    groups = components(open_rows.join(star, "key").select("centre", "node"))
    docs = open_rows.groupBy("node").agg(F.collect_list("key").alias("keys"), F.any_value("n").alias("n"), F.any_value("component").alias("component"))
    docs = docs.join(groups.withColumnsRenamed({"node": "_node", "component": "grp"}), F.col("node") == F.col("_node")).drop("_node")
    sizes = docs.groupBy("grp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(block)), F.ceil(F.sum("n") * 8 / F.lit(BLOCK_BYTES))).cast("int").alias("blocks"))
    docs = docs.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    docs = docs.join(sets.withColumnsRenamed({"id": "_id"}), F.col("node") == F.col("_id")).drop("_id")
    dealt = docs.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    return dealt.select("grp", "lo", "hi", "block", "node", "n", "component", "keys", "shingles").groupBy("grp", "lo", "hi").applyInArrow(_blocks(percent), "u bigint, v bigint")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.sort(np.concatenate([x, y]), kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            keep = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], names=["u", "v"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, offsets, values in shingle_sets(batch.column(1), width):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(offsets) - 1), pa.array([values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], names=["id", "shingles"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold.  Only one side's sets move with the pairs."""
    right = pairs.join(sets.withColumnsRenamed({"id": "_b", "shingles": "y"}), F.col("b") == F.col("_b"))
    both = right.join(sets.withColumnsRenamed({"id": "_a", "shingles": "x"}), F.col("a") == F.col("_a"))
    return both.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "u bigint, v bigint")


def still_open(members: DataFrame, links: DataFrame) -> DataFrame:
    """key, node, n, component: the members of buckets that hold several components."""
    parts = components(links)
    placed = members.join(parts, members["node"] == parts["node"], "left").select("key", members["node"], "n", F.coalesce("component", members["node"]).alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    return placed.join(mixed, "key", "left_semi")


def near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document with its group of near copies.

    Shingles are ``width`` words after lower-casing A-Z; a shorter text is one
    shingle.  Documents link where 100 * intersection >= percent * union of
    their distinct shingles; a group is what links reach, named by its least
    doc_id, whose document is kept.

    Null, empty and wordless texts have no shingles and link with nothing.
    Rows that repeat an id with equal shingles count as one document, each with
    that group; with other shingles they are linked through the id they share.
    Rows with a null id link with nothing: their group is null and they are kept.
    """
    texts = R.text_of(docs)
    signed = stage(texts.mapInArrow(sign(width), SIGNED), "signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    classes = stage(classes, "shingle-classes")
    members = stage(R.repeated(classes.select("node", "n", "bands"), _banded, MEMBERS, buckets(texts, R.BUCKET_BYTES)), "band-members")

    pairs = stage(stars(members, percent), "star-pairs")
    wanted = members.select(F.col("node").alias("_doc")).distinct()
    chosen = texts.join(wanted, F.col("doc_id") == F.col("_doc"), "left_semi").dropDuplicates(["doc_id"])
    sets = stage(chosen.mapInArrow(_sets(width), "id bigint, shingles binary"), "shingle-sets")
    links = stage(confirmed(pairs, sets, percent), "links")
    open_rows = stage(still_open(members, links), "open-members")
    if not open_rows.isEmpty():
        best = best_partners(open_rows, classes.select(F.col("node").alias("_n"), "sketch"), percent)
        links = links.unionByName(stage(confirmed(best, sets, percent), "best-links"))
        open_rows = stage(still_open(members, links), "open-members")
        links = links.unionByName(stage(rest(open_rows, sets, percent), "rest-links"))
    copies = full.select("doc_id", "d1", "d2").join(classes.select("d1", "d2", "node"), ["d1", "d2"]).where("doc_id <> node")
    parts = components(links.unionByName(copies.select(F.col("node").alias("u"), F.col("doc_id").alias("v")).distinct()))
    out = signed.select("doc_id", "n_shingles").join(parts, (F.col("doc_id") == F.col("node")) & (F.col("n_shingles") > 0), "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay when each group of near copies keeps its least doc_id, in the columns of documents.

    Rows that repeat an id are one document: they stay or go together.  Rows
    with a null id always stay.
    """
    columns = ("doc_id", "text", "lang", "source", "n_chars")
    whole = pick(docs, *columns)
    judged = near_copies(docs, width, percent)
    gone = judged.where("not kept").select(F.col("doc_id").alias("_doc")).distinct()
    return whole.join(gone, F.col("doc_id") == F.col("_doc"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"), width=4, percent=80)


#: The links by shared shingles, all pairs of them: for tables of about 1,000 documents.
SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents
), lists AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS ss
  FROM w
), sized AS (
  SELECT doc_id, len(ss) AS n, md5(array_to_string(list_sort(ss), chr(10))) AS same, ss FROM lists
), nodes AS (
  SELECT min(doc_id) AS node, same FROM sized WHERE n > 0 GROUP BY same
), shingles AS (
  SELECT node, n, unnest(ss) AS s FROM nodes JOIN sized ON doc_id = node
), links AS (
  SELECT a.node AS u, b.node AS v FROM shingles a JOIN shingles b ON a.s = b.s AND a.node < b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reached AS (
  SELECT node AS u, node AS v FROM nodes
  UNION
  SELECT r.u, b.v FROM reached r JOIN both_ways b ON r.v = b.u
), parts AS (
  SELECT u AS node, min(v) AS least FROM reached GROUP BY u
)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, coalesce(least, s.doc_id) AS component_id, s.doc_id = coalesce(least, s.doc_id) AS kept
FROM sized s LEFT JOIN nodes k ON s.n > 0 AND s.same = k.same LEFT JOIN parts USING (node)
"""
