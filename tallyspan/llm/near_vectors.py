"""Near duplicates among embeddings by lattice hashing.

Vectors that are equal in label and entries collapse to one class first.  Each
table projects a class's direction twice to eight random dimensions and decodes
both to the nearest point of the lattice E8; the class lives in that pair's cell
and also visits the cells of the neighbouring points that it lies nearest to.
Classes that share a cell, one of them living there, are compared by cosine.

A pair may meet in several cells.  It counts in the first only, which both
sides' cells tell, so links are counted and never listed: a task sends each of
its vectors the number of links found and one link of a spanning forest.  A cell
with many members is compared block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _arrays as A
from . import _repeats as R
from ._base import buckets, pick, stage, table
from ._components import components

LEAST = 0.98
#: Tables, and neighbouring cells that a vector visits in each.
TABLES, PROBES = 6, 3
#: Lattice points in a cell: two, as unrelated vectors share a single one too often.
POINTS = 2
#: A lattice's scale in units of the distance that two vectors at the threshold have after projection, on average.
REACH = 2.83
#: Vectors in a block, and bytes of them.
BLOCK, BLOCK_BYTES = 2000, 4 << 20
#: Bytes of vectors that a task compares at once, and in all, about.
SHARD_BYTES, TASK_BYTES = 4 << 20, 32 << 20
#: Pairs whose cosines stand in memory at once; members of a cell whose pairs are listed for that.
PAIRS, SMALL = 1 << 16, 48
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def lattice_point(y: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row: of whole numbers with an even sum, or the same moved by a half."""

    def even(y: np.ndarray) -> np.ndarray:
        out = np.rint(y)
        rest = y - out
        odd = np.flatnonzero(out.sum(axis=1) % 2 != 0)
        worst = np.abs(rest[odd]).argmax(axis=1)
        out[odd, worst] += np.where(rest[odd, worst] >= 0, 1.0, -1.0)
        return out

    a, b = even(y), even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


@lru_cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two ones of either sign, or halves with an even number of minus signs."""
    ones = np.zeros((112, 8))
    for row, ((i, j), signs) in enumerate(product(combinations(range(8), 2), product((1.0, -1.0), repeat=2))):
        ones[row, [i, j]] = signs
    halves = np.array([h for h in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in h) % 2 == 0])
    return np.concatenate([ones, halves])


@lru_cache(maxsize=256)
def _projection(d: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    """A random orthonormal projection to eight dimensions and a random shift, the same in every task."""
    random = np.random.default_rng([d, t])
    basis, _ = np.linalg.qr(random.standard_normal((max(d, 8), 8)))
    return basis[:d] if d >= 8 else np.linalg.qr(random.standard_normal((8, 8)))[0][:d], random.random(8)


def _key(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A digest of each lattice point (rows of the last axis)."""
    doubled = np.rint(points * 2).astype(np.int64).view(np.uint64)
    key = salt
    for j in range(8):
        key = A.mix(key + doubled[..., j])
    return key


def cells(unit: np.ndarray, label: np.ndarray, least: float = LEAST) -> np.ndarray:
    """vectors x tables x (1 + PROBES): the cell that each unit vector lives in and those it visits, as digests with the label's.

    A cell is POINTS lattice points, each of a projection of its own; a visit
    moves one of them to a neighbour.
    """
    n, d = unit.shape
    scale = REACH * np.sqrt(2 - 2 * least) * np.sqrt(min(1.0, 8 / d))
    out = np.empty((n, TABLES, 1 + PROBES), np.uint64)
    for t in range(TABLES):
        homes, own, gains = [], [], []
        for b in range(POINTS):
            basis, shift = _projection(d, t * POINTS + b)
            y = unit @ basis / scale + shift
            homes.append(lattice_point(y))
            own.append(_key(homes[b], np.full(n, b, np.uint64)))
            gains.append((y - homes[b]) @ neighbours().T)
        nearest = np.argpartition(-np.concatenate(gains, axis=1), PROBES, axis=1)[:, :PROBES]
        whole = np.sum(own, axis=0, dtype=np.uint64)
        salt = A.mix(label + np.uint64(t * 0x10001 + d))
        out[:, t, 0] = A.mix(whole ^ salt)
        for p in range(PROBES):
            point, move = np.divmod(nearest[:, p], len(neighbours()))
            for b in range(POINTS):
                some = np.flatnonzero(point == b)
                moved = _key(homes[b][some] + neighbours()[move[some]], np.full(len(some), b, np.uint64))
                out[some, t, 1 + p] = A.mix((whole[some] - own[b][some] + moved) ^ salt[some])
    return out


def units(raw: list[bytes], kind: str) -> np.ndarray:
    """The directions of vectors of one dimension."""
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square is beyond a double
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_dimension(raw: pa.Array) -> Iterator[np.ndarray]:
    sizes = pc.binary_length(raw).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


ROW = "vec_id bigint, label string, v binary"


def _packed(kind: str):
    """The entries of every vector that can link, as bytes; null for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = []
            for v, labelled in zip(batch.column(1), batch.column(2).is_valid().to_pylist(), strict=True):
                entries = v.values if labelled and v.is_valid else None
                if entries is None or entries.null_count or not len(entries):
                    out.append(None)
                    continue
                x = entries.to_numpy(zero_copy_only=False).astype(kind)
                out.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], names=["vec_id", "label", "v"])

    return run


MEMBERS: R.Fields = (("key", np.uint64), ("node", np.int64), ("home", np.int16))


def _in_cells(kind: str, least: float):
    """A row for every cell that a class lives in or visits."""

    def produce(batch: pa.RecordBatch) -> Iterator[R.Rows]:
        node, label = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        raw = batch.column(2).to_pylist()
        for some in _by_dimension(batch.column(2)):
            keys = cells(units([raw[i] for i in some], kind), label[some], least).reshape(-1)
            home = np.zeros((len(some) * TABLES, 1 + PROBES), np.int16)
            home[:, 0] = 1
            yield {"key": keys, "node": np.repeat(node[some], TABLES * (1 + PROBES)), "home": home.reshape(-1)}

    return produce


def first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of rows of ``cells``: the cell of the first table in which they meet, of two the least."""
    out = np.full(len(a), _NONE)
    for t in range(TABLES - 1, -1, -1):
        x, y = a[:, t], b[:, t]
        one = np.where((x == y[:, :1]).any(axis=1), y[:, 0], _NONE)
        two = np.where((y == x[:, :1]).any(axis=1), x[:, 0], _NONE)
        met = np.minimum(one, two)
        out = np.where(met != _NONE, met, out)
    return out


def _candidates(begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows of each small group, about PAIRS at a time."""
    for g in np.unique(size):
        starts = begin[size == g]
        i, j = np.triu_indices(g, 1)
        step = max(1, PAIRS // len(i))
        for at in range(0, len(starts), step):
            some = starts[at : at + step, None]
            yield (some + i).reshape(-1), (some + j).reshape(-1)


FOUND = "u bigint, v bigint, n bigint"


def compared(kind: str, least: float):
    """Of a shard's cells: for each vector the links that count here, and one link of a spanning forest."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        node, slot = np.unique(rows.column("node").to_numpy(), return_index=True)
        row_of = np.searchsorted(node, rows.column("node").to_numpy())
        own = rows.take(pa.array(slot))
        weight, label = own.column("m").to_numpy(), own.column("g").to_numpy().view(np.uint64)
        _, name = np.unique(np.array(own.column("label").to_pylist(), object), return_inverse=True)
        raw = own.column("v").to_pylist()
        h, part = rows.column("h").to_numpy().view(np.uint64), rows.column("part").to_numpy()
        home, block, across = rows.column("home").to_numpy() == 1, rows.column("block").to_numpy(), rows.column("across").to_numpy(zero_copy_only=False)
        turn = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (part[1:] != part[:-1])))
        size = np.diff(np.append(turn, len(h)))
        dimension = pc.binary_length(own.column("v").combine_chunks()).to_numpy(zero_copy_only=False)
        place, unit, where = np.zeros(len(node), np.int64), {}, np.empty((len(node), TABLES, 1 + PROBES), np.uint64)
        for some in _by_dimension(own.column("v").combine_chunks()):
            held = units([raw[i] for i in some], kind)
            unit[dimension[some[0]]] = held
            place[some] = np.arange(len(some))
            where[some] = cells(held, label[some], least)
        count, lows, highs = np.zeros(len(node), np.int64), [], []

        def take(i: np.ndarray, j: np.ndarray) -> None:
            """Pairs of rows at the threshold: those that meet here first count."""
            a, b = row_of[i], row_of[j]
            fits = (home[i] | home[j]) & (name[a] == name[b]) & (~across[i] | (block[i] != block[j])) & (a != b)
            i, a, b = i[fits], a[fits], b[fits]
            fits = first_meeting(where[a], where[b]) == h[i]
            a, b = a[fits], b[fits]
            np.add.at(count, a, weight[b])
            np.add.at(count, b, weight[a])
            lows.append(np.minimum(a, b))
            highs.append(np.maximum(a, b))

        def linked(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            a, b = row_of[i], row_of[j]
            keep = []
            for d, held in unit.items():
                same = np.flatnonzero((dimension[a] == d) & (dimension[b] == d))
                near = np.einsum("ij,ij->i", held[place[a[same]]], held[place[b[same]]]) >= least
                keep.append(same[near])
            keep = np.concatenate(keep)
            return i[keep], j[keep]

        small = (size > 1) & (size <= SMALL)
        for i, j in _candidates(turn[small], size[small]):
            take(*linked(i, j))
        for begin, g in zip(turn[size > SMALL], size[size > SMALL], strict=True):
            for d, held in unit.items():
                some = begin + np.flatnonzero(dimension[row_of[begin : begin + g]] == d)
                x = held[place[row_of[some]]]
                step = max(1, PAIRS * 4 // max(1, len(some)))
                for at in range(0, len(some), step):
                    i, j = np.nonzero(x[at : at + step] @ x[at:].T >= least)
                    later = j > i
                    take(some[at + i[later]], some[at + j[later]])
        lows, highs = (np.concatenate([np.empty(0, np.int64), *x]) for x in (lows, highs))
        root = np.arange(len(node))
        while len(lows):
            low = np.minimum(root[lows], root[highs])
            before = root.copy()
            for x in (root[lows], root[highs], lows, highs):
                np.minimum.at(root, x, low)
            root = root[root]
            if (root == before).all():
                break
        met = np.flatnonzero(count)
        return pa.table([pa.array(node[met]), pa.array(node[root[met]]), pa.array(count[met])], names=["u", "v", "n"])

    return run


def links(classes: DataFrame, kind: str, least: float, n_buckets: int) -> DataFrame:
    """u, v, n: for classes (node, label, g, m, v) the vectors that they link with, by parts, and links that join what is linked."""
    cells_of = R.repeated(classes.select("node", "g", "v"), _in_cells(kind, least), MEMBERS, n_buckets)
    members = stage(cells_of, "cell-members")
    widest = classes.agg(F.max(F.octet_length("v"))).first()[0] or 8  # one number
    block = max(64, min(BLOCK, BLOCK_BYTES // widest))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max("home").alias("lived")).where("c > 1 and lived = 1")
    sizes = stage(sizes.select("key", "c", F.ceil(F.col("c") / F.lit(block)).cast("int").alias("blocks")), "cell-sizes")
    total = sizes.agg(F.sum(F.col("c") * F.col("blocks"))).first()[0] or 0  # one number
    tasks = int(max(2 * classes.sparkSession.sparkContext.defaultParallelism, total * widest // TASK_BYTES))
    dealt = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")
    dealt = dealt.select(F.col("key").alias("h"), part.cast("int").alias("part"), (F.col("block") != F.col("other")).alias("across"), F.col("node").alias("_node"), "home", "block")
    # A pair of blocks holds each of its vectors once; ``across`` says that only pairs between the two count, as others do in a block's own part.
    whole = dealt.join(classes, F.col("_node") == F.col("node")).select("h", "part", "across", "node", "home", "block", "label", "g", "m", "v")
    ordered = whole.repartition(tasks, "h", "part").sortWithinPartitions("h", "part")
    return stage(ordered.mapInArrow(R.stream_shards(compared(kind, least), "v", SHARD_BYTES), FOUND), "vector-links")


def near_vectors(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each vector with the number of others it links with and its group.

    Vectors of one label link where their cosine, in doubles, is at least
    ``least``, as far as they share a cell (recall is measured in the tests).
    A group is what links reach, named by its least vec_id, which is kept.

    Null labels, and vectors that are null, empty, zero or hold null or
    non-finite entries, link with nothing, as do vectors of other dimensions.
    Each row is a vector: rows that repeat link with one another, also under
    one id.  A row without an id may link; it is kept only where no row of its
    group has one.  Other columns are left out.
    """
    rows = pick(rows, "vec_id", "embedding", "label")
    kind = "<f4" if isinstance(rows.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"
    typed = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    packed = typed.mapInArrow(_packed(kind), ROW)
    name = F.concat(F.octet_length("label").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("label").cast("binary"), F.col("v"))
    packed = packed.withColumn("k", F.when(F.col("v").isNotNull(), F.unhex(F.sha2(name, 256))))
    classes = packed.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("lo"), F.any_value("label").alias("label"), F.any_value("v").alias("v"))
    classes = stage(classes.select(F.monotonically_increasing_id().alias("node"), "k", "m", "lo", "label", F.xxhash64("label").alias("g"), "v"), "vector-classes")
    found = links(classes.select("node", "label", "g", "m", "v"), kind, least, buckets(rows, R.BUCKET_BYTES))
    degree = found.groupBy(F.col("u").alias("_u")).agg(F.sum("n").alias("n"))
    parts = components(found.select("u", "v")).withColumnsRenamed({"node": "_p", "component": "grp"})
    placed = classes.select("node", "k", "m", "lo").join(degree, F.col("node") == F.col("_u"), "left").join(parts, F.col("node") == F.col("_p"), "left")
    placed = stage(placed.where("m > 1 or n is not null").select("k", "lo", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("grp", "node").alias("grp")), "linked-classes")
    named = placed.groupBy(F.col("grp").alias("_grp")).agg(F.min("lo").alias("least"))
    told = placed.join(named, F.col("grp") == F.col("_grp")).select(F.col("k").alias("_k"), "n_links", "least", F.lit(True).alias("met"))
    out = packed.select("vec_id", "k").join(told, F.col("k") == F.col("_k"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("met"), F.col("least")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: All pairs of a label: for tables of some thousand vectors.
SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {LEAST}
), reached AS (
  SELECT DISTINCT u AS node, u AS least FROM links
  UNION
  SELECT r.node, l.w FROM reached r JOIN links l ON l.u = r.least
), parts AS (
  SELECT node, min(least) AS least FROM reached GROUP BY node
), degree AS (
  SELECT u, count(*) AS n FROM links GROUP BY u
)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(least, e.vec_id) AS component_id, e.vec_id = coalesce(least, e.vec_id) AS kept
FROM embeddings e LEFT JOIN degree ON u = e.vec_id LEFT JOIN parts ON node = e.vec_id
"""
