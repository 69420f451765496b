"""A Merkle manifest of a dataset: ternary trees over each source's documents, and one over the sources.

Leaves are put in order of (source, doc_id) by ranges, so a part of the table
is a stretch of that order.  A part's fragment is a sparse forest: the nodes
that it can't resolve alone, keyed by tree, level and index.  Merging two
fragments unites their nodes and replaces every run of siblings that is then
complete by its parent; as each tree's size is known, so is the arity of its
last runs.  Merging is associative, and a stretch of any length leaves a few
nodes for each level, so fragments are reduced as a tree, FAN at a time, until
the root is all that remains.  The rounds are written, and walked back to give
each fragment the siblings above its unresolved nodes; what a part resolved by
itself it knows again.  Only the root, and one line about each part, reach the driver.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import pick, stage, table

ARITY = 3
#: Leaves in a part, about; fragments that one task merges.
ROWS, FAN = 1 << 15, 32
#: The tree over the sources; those over documents are numbered by source.
TOP = -1
#: In a path, where the tree over the sources begins.
_CROSSING = 0xFF

Node = tuple[int, int, int]


def _field(c: str | Column) -> Column:
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, bad: each document's leaf, and that of its tampered text where it has one (else null)."""
    docs = pick(docs, "doc_id", "source", "lang", "n_chars", "text")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), "lang", "n_chars", F.col("text").cast("string").alias("text"))
    whole = lambda text: F.unhex(F.sha2(F.concat(*[_field(c) for c in ("doc_id", "source", "lang", "n_chars")], _field(text)), 256))
    picked = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.col("text").contains("\n")
    bad = F.when(picked, whole(F.translate("text", "\n", "")))
    return docs.select("doc_id", "source", whole("text").alias("leaf"), bad.alias("bad"))


def in_order(held: DataFrame, rows: int) -> DataFrame:
    """The leaves with ``part``: parts follow one another in the order of source and doc_id, nulls first, each about ``rows`` long.

    Rows of equal source and id follow the order of their leaves; a random last
    key splits rows that are equal throughout.
    """
    parts = max(1, -(-held.count() // rows))
    salted = held.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    keys = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("salt")]
    return salted.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id().cast("bigint"))


FRAME = "part bigint, base bigint, rank bigint, first_size bigint, last_size bigint"


def frames(parts: DataFrame) -> tuple[list[tuple], int]:
    """For each part: leaves of its first source in parts before it, that source's number, and the sizes of its first and last source; and the number of sources.

    One line for each part comes to the driver, however many sources there are.
    """
    each = parts.groupBy("part", "source").agg(F.count(F.lit(1)).alias("c"))
    each = each.groupBy("part").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("source", "c")).alias("lo"), F.max(F.struct("source", "c")).alias("hi"))
    lines = sorted(each.collect(), key=lambda r: r["part"])
    later = [0] * len(lines)  # leaves of a part's last source in the parts after it
    for i in range(len(lines) - 2, -1, -1):
        after = lines[i + 1]
        if after["lo"]["source"] == lines[i]["hi"]["source"]:
            later[i] = after["lo"]["c"] + (later[i + 1] if after["k"] == 1 else 0)
    out, known, run = [], 0, 0
    for i, r in enumerate(lines):
        goes_on = i > 0 and lines[i - 1]["hi"]["source"] == r["lo"]["source"]
        base = run if goes_on else 0
        rank = known - 1 if goes_on else known
        known = rank + r["k"]
        run = r["hi"]["c"] + (base if r["k"] == 1 else 0)
        first = base + r["lo"]["c"] + (later[i] if r["k"] == 1 else 0)
        out.append((r["part"], base, rank, first, first if r["k"] == 1 else run + later[i]))
    return out, known


def joined(digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(digests).hex().encode("ascii")).digest()


def width(size: int, level: int) -> int:
    return -(-size // ARITY**level)


def settle(nodes: dict[Node, bytes], sizes: dict[int, int]) -> dict[Node, list[bytes]]:
    """Replace complete runs of siblings by their parents until none is left, in place; returns each parent's run.

    A tree's last node becomes a leaf of the tree over the sources; that one's last node is the root.
    """
    runs: dict[Node, list[bytes]] = {}
    todo = list(nodes)
    while todo:
        key = todo.pop()
        if key not in nodes:
            continue
        tree, level, index = key
        wide = width(sizes[tree], level)
        if wide == 1:
            if tree != TOP:
                nodes[TOP, 0, tree] = nodes.pop(key)
                todo.append((TOP, 0, tree))
            continue
        first = index // ARITY * ARITY
        run = [(tree, level, i) for i in range(first, min(first + ARITY, wide))]
        if all(k in nodes for k in run):
            parent = (tree, level + 1, index // ARITY)
            runs[parent] = [nodes.pop(k) for k in run]
            nodes[parent] = joined(runs[parent])
            todo.append(parent)
    return runs


class Paths:
    """The siblings on the way from a node to the root: a byte for the run's size and the own place in it, then the others."""

    def __init__(self, runs: dict[Node, list[bytes]], sizes: dict[int, int], above: dict[Node, bytes]):
        self._runs, self._sizes, self._held = runs, sizes, dict(above)

    def of(self, key: Node, keep: bool = True) -> bytes:
        if key in self._held:
            return self._held[key]
        tree, level, index = key
        if width(self._sizes[tree], level) == 1:
            path = bytes([_CROSSING]) + self.of((TOP, 0, tree))
        else:
            run, place = self._runs[tree, level + 1, index // ARITY], index % ARITY
            path = bytes([len(run) * 4 + place]) + b"".join(run[:place] + run[place + 1 :]) + self.of((tree, level + 1, index // ARITY))
        if keep:
            self._held[key] = path
        return path


def fold(leaf: bytes, path: bytes) -> tuple[bytes, bytes, bytes]:
    """The subroot and the root that a leaf and its siblings give, and the siblings."""
    held, subroot, at, siblings = leaf, leaf, 0, []
    while at < len(path):
        told = path[at]
        at += 1
        if told == _CROSSING:
            subroot = held
            continue
        size, place = told >> 2, told & 3
        others = [path[at + 32 * i : at + 32 * i + 32] for i in range(size - 1)]
        at += 32 * (size - 1)
        siblings += others
        held = joined([*others[:place], held, *others[place:]])
    return subroot, held, b"".join(siblings)


NODES = "child bigint, tree bigint, level int, idx bigint, size bigint, digest binary"
PATHS = "child bigint, tree bigint, level int, idx bigint, path binary"


def _part(rows: pa.Table, sources: int) -> tuple[pa.Table, list[Node], dict[Node, bytes], dict[int, int]]:
    """A part's rows in order, their keys, its nodes and the sizes of its trees."""
    order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("source", "doc_id", "leaf", "salt")], null_placement="at_start")
    rows = rows.take(order)
    base, rank, first, last = (rows.column(c)[0].as_py() for c in ("base", "rank", "first_size", "last_size"))
    names = rows.column("source").to_pylist()
    starts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
    sizes, keys = {TOP: sources}, []
    for j, (a, b) in enumerate(zip(starts, [*starts[1:], len(names)], strict=True)):
        sizes[rank + j] = first if j == 0 else last if b == len(names) else b - a
        keys += [(rank + j, 0, i + (base if j == 0 else 0)) for i in range(b - a)]
    nodes = dict(zip(keys, rows.column("leaf").to_pylist(), strict=True))
    return rows, keys, nodes, sizes


def _unresolved(child: int, nodes: dict[Node, bytes], sizes: dict[int, int]) -> pa.Table:
    rows = [(child, *key, sizes[key[0]], digest) for key, digest in nodes.items()]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["child", "tree", "level", "idx", "size", "digest"])


def _fragment(sources: int):
    def run(rows: pa.Table) -> pa.Table:
        _, _, nodes, sizes = _part(rows, sources)
        settle(nodes, sizes)
        return _unresolved(rows.column("part")[0].as_py(), nodes, sizes)

    return run


def _nodes(rows: pa.Table, sources: int) -> tuple[dict[Node, bytes], dict[int, int], dict[Node, int]]:
    keys = list(zip(*[rows.column(c).to_pylist() for c in ("tree", "level", "idx")], strict=True))
    sizes = dict(zip(rows.column("tree").to_pylist(), rows.column("size").to_pylist(), strict=True)) | {TOP: sources}
    return dict(zip(keys, rows.column("digest").to_pylist(), strict=True)), sizes, dict(zip(keys, rows.column("child").to_pylist(), strict=True))


def _merged(sources: int):
    def run(rows: pa.Table) -> pa.Table:
        nodes, sizes, _ = _nodes(rows, sources)
        settle(nodes, sizes)
        return _unresolved(rows.column("grp")[0].as_py(), nodes, sizes)

    return run


def _above(rows: pa.Table) -> dict[Node, bytes]:
    keys = zip(*[rows.column(c).to_pylist() for c in ("tree", "level", "idx")], strict=True)
    return dict(zip(keys, rows.column("path").to_pylist(), strict=True))


def _handed_down(sources: int):
    """The paths of the nodes that a group's fragments had left, from those that the group itself left."""

    def run(rows: pa.Table, above: pa.Table) -> pa.Table:
        nodes, sizes, child = _nodes(rows, sources)
        paths = Paths(settle(nodes, sizes), sizes, _above(above))
        found = [(c, *key, paths.of(key)) for key, c in child.items()]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        return pa.table([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=["child", "tree", "level", "idx", "path"])

    return run


MANIFEST = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _judged(sources: int, root: bytes):
    def run(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows, keys, nodes, sizes = _part(rows, sources)
        paths = Paths(settle(nodes, sizes), sizes, _above(above))
        out: list[list] = [[] for _ in range(6)]
        for key, leaf, bad in zip(keys, rows.column("leaf").to_pylist(), rows.column("bad").to_pylist(), strict=True):
            path = paths.of(key, keep=False)
            subroot, whole, siblings = fold(leaf, path)
            again = whole if bad is None else fold(bad, path)[1]
            row = (leaf.hex(), subroot.hex(), root.hex(), hashlib.sha256(siblings.hex().encode("ascii")).hexdigest(), again.hex(), again == root)
            for column, value in zip(out, row, strict=True):
                column.append(value)
        return pa.table([rows.column("doc_id"), *[pa.array(c, pa.string()) for c in out[:5]], pa.array(out[5], pa.bool_())], names=[f.split()[0] for f in MANIFEST.split(", ")])

    return run


def manifest(docs: DataFrame, rows: int = ROWS, fan: int = FAN) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row for each document, digests as hex text.

    A document that is tampered with (its id's CRC-32 is even, and its text has
    a line feed) is folded from the leaf of its text without line feeds, up the
    siblings of the untampered trees; it is verified if that gives the root.

    Null columns have a field of their own in the leaf; an empty text is not a
    null one.  A null source is a source, the first.  Null ids come first in
    their source and aren't tampered with.  Rows that share an id stand in the
    order of their leaves, and equal rows are leaves of their own.  An empty
    table gives no rows.  Other columns are left out.
    """
    spark = docs.sparkSession
    held = stage(leaves(docs), "leaves")
    parts = stage(in_order(held, rows), "leaf-parts")
    lines, sources = frames(parts)
    if not lines:
        return spark.createDataFrame([], MANIFEST)
    # A line of five numbers for each ``rows`` leaves; Spark broadcasts it while it is small.
    placed = parts.join(spark.createDataFrame(lines, FRAME), "part")
    rounds = [stage(placed.groupBy("part").applyInArrow(_fragment(sources), NODES), "fragments")]
    grouped = lambda df: df.withColumn("grp", F.floor(F.col("child") / F.lit(fan)).cast("bigint")).groupBy("grp")
    left = lines[-1][0] + 1
    while left > 1:
        rounds.append(stage(grouped(rounds[-1]).applyInArrow(_merged(sources), NODES), "fragments"))
        left = -(-left // fan)
    top = rounds.pop().first()  # the root
    above = spark.createDataFrame([(0, top["tree"], top["level"], top["idx"], bytearray())], PATHS)
    for below in reversed(rounds):
        above = stage(grouped(below).cogroup(above.withColumnRenamed("child", "grp").groupBy("grp")).applyInArrow(_handed_down(sources), PATHS), "paths")
    own = above.withColumnRenamed("child", "part").groupBy("part")
    return placed.groupBy("part").cogroup(own).applyInArrow(_judged(sources, bytes(top["digest"])), MANIFEST)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def _sql_field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


_HEAD = " || ".join(_sql_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
#: CRC-32 stands as a table of its 256 steps, made by the rule.
SQL = f"""
WITH RECURSIVE bytes AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps FROM range(256) t(i)
), crc AS (
  SELECT doc_id, source, {_HEAD} AS head, text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda c, d: xor(steps[(xor(c, d) & 255) + 1], c >> 8)), 4294967295) AS c
  FROM documents, bytes
), docs AS (
  SELECT doc_id, sha256(head || {_sql_field("text")}) AS leaf, sha256(head || CASE WHEN c % 2 = 0 THEN {_sql_field("replace(text, chr(10), '')")} ELSE {_sql_field("text")} END) AS folded,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
  FROM crc
), nodes AS (
  SELECT tree, 0 AS level, i, n, leaf AS h FROM docs
  UNION ALL
  SELECT tree, level + 1, i // 3, (min(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, level, i // 3
), tops AS (
  SELECT 0 AS level, tree AS i, count(*) OVER () AS n, h FROM nodes WHERE n = 1
  UNION ALL
  SELECT level + 1, i // 3, (min(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 3
), siblings AS (
  SELECT doc_id, 0 AS k, s.level, s.i, s.h FROM docs d JOIN nodes s ON s.tree = d.tree AND s.n > 1 AND s.i // 3 = d.i // (3 ** (s.level + 1))::BIGINT AND s.i <> d.i // (3 ** s.level)::BIGINT
  UNION ALL
  SELECT doc_id, 1, s.level, s.i, s.h FROM docs d JOIN tops s ON s.n > 1 AND s.i // 3 = d.tree // (3 ** (s.level + 1))::BIGINT AND s.i <> d.tree // (3 ** s.level)::BIGINT
), proofs AS (
  SELECT doc_id, string_agg(h, '' ORDER BY k, level, i) AS p FROM siblings GROUP BY doc_id
), up AS (
  SELECT doc_id, tree, 0 AS level, i, n, folded AS h FROM docs
  UNION ALL
  SELECT doc_id, u.tree, u.level + 1, u.i // 3, (min(u.n) + 2) // 3, sha256(string_agg(CASE WHEN s.i = u.i THEN u.h ELSE s.h END, '' ORDER BY s.i))
  FROM up u JOIN nodes s ON s.tree = u.tree AND s.level = u.level AND s.i // 3 = u.i // 3 WHERE u.n > 1 GROUP BY doc_id, u.tree, u.level, u.i
), over_all AS (
  SELECT doc_id, 0 AS level, tree AS i, (SELECT max(n) FROM tops) AS n, h FROM up WHERE n = 1
  UNION ALL
  SELECT doc_id, u.level + 1, u.i // 3, (min(u.n) + 2) // 3, sha256(string_agg(CASE WHEN s.i = u.i THEN u.h ELSE s.h END, '' ORDER BY s.i))
  FROM over_all u JOIN tops s ON s.level = u.level AND s.i // 3 = u.i // 3 WHERE u.n > 1 GROUP BY doc_id, u.level, u.i
)
SELECT d.doc_id, d.leaf, b.h AS subroot, r.h AS root, sha256(coalesce(p, '')) AS proof_sha256, o.h AS folded_root, o.h = r.h AS verified
FROM docs d JOIN tops b ON b.level = 0 AND b.i = d.tree JOIN tops r ON r.n = 1 JOIN over_all o ON o.doc_id = d.doc_id AND o.n = 1 LEFT JOIN proofs q ON q.doc_id = d.doc_id
"""
