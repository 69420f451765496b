"""Families of copies, and runs of lines that repeat.

Exact copies meet by digest.  Near copies are scored by the multiset Dice
coefficient in parts of ten thousand, on one member of each exact family.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, staged

NEAR = 7500
#: Tokens that a task gathers before it sends them, bytes of input for each bucket they meet in, and bytes of an Arrow batch.
HELD, BUCKET_BYTES, BATCH_BYTES = 400_000, 8 << 20, 8 << 20
#: Members up to which a token's bucket is compared by pairs; larger ones are compared in blocks of so many multisets and bytes.
LIGHT, BLOCK, BLOCK_BYTES = 64, 2000, 8 << 20
#: Links that one task may join.
HERE = 1 << 20
_LONE, _WITNESS, _TOLD, _SIZES = range(4)


def canonical(tokens: Column) -> Column:
    """Tokens as the place where each first occurs, so that renaming all of one changes nothing."""
    return F.transform(tokens, lambda t: F.array_position(tokens, t))


def exact_families(df: DataFrame, key: str, body: Column) -> DataFrame:
    """key, family, size: members of equal bodies; the family is named by its least key.  Nulls are in no family."""
    rows = df.select(key, F.sha2(body, 256).alias("_d")).where("_d is not null")
    sizes = rows.groupBy("_d").agg(F.min(key).alias("family"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return rows.join(sizes, "_d").select(key, "family", "size")


def size_bound(size: Column, other: Column, least: int = NEAR) -> Column:
    """Whether two sizes allow a Dice coefficient of ``least``."""
    return (F.greatest(size, other) * least) <= (F.least(size, other) * (20000 - least))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _occurrences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Digests of each row's tokens and the number of them in each row; the second, third ... of equal ones are told apart, so multisets become sets."""
    n = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    t = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    order = np.lexsort((t, row))
    t = t[order]
    begins = np.append(True, (t[1:] != t[:-1]) | (row[1:] != row[:-1]))[: len(t)]
    at = np.arange(len(t))
    nth = at - np.maximum.accumulate(np.where(begins, at, 0))
    more = np.flatnonzero(nth)
    t[more] = _mixed(t[more] ^ _mixed(nth[more].astype(np.uint64)))
    return t, n


def _twins(keys: np.ndarray) -> np.ndarray:
    """Which of these keys occur more than once."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _squeezed(ids: np.ndarray) -> bytes:
    """Ids as steps of two bytes after the first, where they are such, else whole; the first byte tells."""
    steps = np.diff(ids)
    if len(ids) and steps.min(initial=0) >= 0 and steps.max(initial=0) < 1 << 16:
        return b"\1" + ids[:1].tobytes() + steps.astype(np.uint16).tobytes()
    return b"\0" + ids.tobytes()


def _whole(packed: bytes) -> np.ndarray:
    if packed[0]:
        return np.cumsum(np.append(np.frombuffer(packed, np.int64, 1, 1), np.frombuffer(packed, np.uint16, -1, 9)), dtype=np.int64)
    return np.frombuffer(packed, np.int64, -1, 1)


_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("t", pa.binary()), ("k", pa.binary())])
_MEMBERS = pa.schema([("t", pa.int64()), ("k", pa.int64()), ("n", pa.int64())])


def _deal(n_buckets: int):
    """A mapInArrow function: occurrences packed by the bucket of their digest.

    A task that holds one several times knows that it repeats: it sends those
    rows on without their meeting others, and one witness, so a frequent
    token's bucket gets one row of each task.
    """

    def packed(kind: int, bucket: np.ndarray, t: np.ndarray, k: np.ndarray | None) -> pa.RecordBatch:
        order = np.argsort(bucket, kind="stable")
        bucket, t = bucket[order], t[order]
        cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        ks = [b""] * len(spans) if k is None else [_squeezed(k[order][a:b]) for a, b in spans] if len(spans) < 2 else [_squeezed(x) for x in np.split(k[order], cuts[1:-1])]
        columns = [pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array(np.full(len(spans), kind, np.int32)), pa.array([t[a:b].tobytes() for a, b in spans], pa.binary()), pa.array(ks, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, schema=_PACKED)

    def sent(t: np.ndarray, k: np.ndarray) -> Iterator[pa.RecordBatch]:
        told = _twins(t)
        witness = np.unique(t[told])
        by = lambda x: ((_mixed(x) >> np.uint64(24)) % np.uint64(n_buckets)).astype(np.int64)
        yield packed(_LONE, by(t[~told]), t[~told], k[~told])
        yield packed(_WITNESS, by(witness), witness, None)
        yield packed(_TOLD, by(k[told].view(np.uint64)), t[told], k[told])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            t, n = _occurrences(batch.column(1))
            k = batch.column(0).to_numpy(zero_copy_only=False)
            full = np.flatnonzero(n)
            yield packed(_SIZES, ((_mixed(k[full].view(np.uint64)) >> np.uint64(24)) % np.uint64(n_buckets)).astype(np.int64), n[full], k[full])
            held.append((t, np.repeat(k, n)))
            size += len(t)
            if size >= HELD:
                yield from sent(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
        if size:
            yield from sent(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _meet(rows: pa.Table) -> pa.Table:
    """Of a bucket, the occurrences (t, k) that stand in several multisets, and sizes (null, k, n)."""
    kind, ts, ks = rows.column("kind").to_numpy(), rows.column("t").to_pylist(), rows.column("k").to_pylist()
    of = lambda which: (np.frombuffer(b"".join(ts[i] for i in np.flatnonzero(kind == which)), np.int64), np.concatenate([np.empty(0, np.int64), *[_whole(ks[i]) for i in np.flatnonzero(kind == which) if ks[i]]]))
    lone, lone_k = of(_LONE)
    keep = _twins(np.concatenate([lone, of(_WITNESS)[0]]))[: len(lone)]
    told, told_k = of(_TOLD)
    n, n_k = of(_SIZES)
    t = np.concatenate([lone[keep], told, n])
    sized = np.arange(len(t)) >= len(t) - len(n)
    return pa.table([pa.array(t, mask=sized), pa.array(np.concatenate([lone_k[keep], told_k, n_k])), pa.array(np.where(sized, t, 0), mask=~sized)], schema=_MEMBERS)


def _buckets(df: DataFrame) -> int:
    """How many buckets keep each at about BUCKET_BYTES of input, by the optimizer's statistics."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(8, -(-sum(s for s in sizes if 0 < s < 1 << 62) // BUCKET_BYTES))


def _release(df: DataFrame) -> None:
    """Let go of the shuffle files of finished plans, which else stay until the driver happens to collect its garbage."""
    for pause in (0.3, 0.7):
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(pause)


def _needed(n: Column, least: int) -> Column:
    """The least intersection of a multiset of n with any that is near."""
    return F.ceil(n * least / F.lit(20000 - least))


def _ordered(least: int):
    """A mapInArrow function: of each (k, n, l) the shared occurrences in order, and in the order from rare to frequent those on which a near one must meet it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = pa.compute.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            inner = batch.column(2).flatten()
            m, t = (inner.field(x).to_numpy(zero_copy_only=False) for x in ("m", "t"))
            row = np.repeat(np.arange(len(length)), length)
            by_rarity, by_value = t[np.lexsort((t, m, row))], t[np.lexsort((t, row))]
            at = np.append(0, np.cumsum(length))
            need = batch.column(3).to_numpy(zero_copy_only=False)
            d = [by_value[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            p = [by_rarity[a : b - c + 1].tobytes() for a, b, c in zip(at[:-1], at[1:], need, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d, pa.binary()), pa.array(p, pa.binary())], names=["k", "n", "d", "p"])

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p = batch.column(2).to_pylist()
        n = np.array([len(x) // 8 for x in p], np.int64)
        k, size = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), n) for i in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.frombuffer(b"".join(p), np.int64)), pa.array(size)], names=["k", "t", "n"])


def _prefixes(df: DataFrame, key: str, tokens: Column, least: int, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The multisets that may have a near one (k, n, d, p), and of each the tokens on which it must meet it (k, t, n), n being its size.

    Only a few tokens of each multiset can tell: in an order from rare to
    frequent, two multisets that reach the threshold share one of their first
    n - ceil(n * least / (20000 - least)) + 1 occurrences.  Tokens of one
    multiset alone meet nothing and come first, so a multiset of too many of
    them has no near one and is dropped.

    Tokens travel once, as 64-bit digests; what stays are those that several
    multisets hold.  ``key`` is a bigint.  Rows that repeat a key are one
    multiset.  With ``only`` (k) the multisets of other keys are left out; they
    may still count in the order, which any numbers would do for.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    digests = F.transform(F.filter(tokens, lambda t: t.isNotNull()), lambda t: F.xxhash64(t))
    rows = df.select(F.col(key).cast("bigint").alias("k"), digests.alias("ts")).where("k is not null and ts is not null")
    if not df.groupBy(key).count().where("count > 1").isEmpty():
        rows = rows.groupBy("k").agg(F.flatten(F.collect_list("ts")).alias("ts"))
    members = staged(rows.mapInArrow(_deal(_buckets(df)), "bucket int, kind int, t binary, k binary").groupBy("bucket").applyInArrow(_meet, "t bigint, k bigint, n bigint"))
    _release(df)
    shared, sizes = members.where("t is not null").select("t", "k"), members.where("t is null").select("k", "n")
    if only is not None:
        sizes = sizes.join(only.select(F.col("k").cast("bigint").alias("k")), "k", "left_semi")
    enough = shared.groupBy("k").agg(F.count(F.lit(1)).alias("_s")).join(sizes, "k").withColumn("need", _needed(F.col("n"), least)).where("_s >= need").select("k", "n", "need")
    enough = staged(enough)
    rare = shared.groupBy("t").agg(F.count(F.lit(1)).alias("m"))
    lists = shared.join(enough.select("k"), "k", "left_semi").join(rare, "t").groupBy("k").agg(F.collect_list(F.struct("m", "t")).alias("l"))
    sets = staged(lists.join(enough, "k").select("k", "n", "l", "need").mapInArrow(_ordered(least), "k bigint, n bigint, d binary, p binary"))
    _release(df)
    prefix = sets.select("k", "n", "p").mapInArrow(_listed, "k bigint, t bigint, n bigint")
    return sets, prefix.join(prefix.groupBy("t").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("t"), "t", "left_semi").select("k", "t", "n")


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, x, y, total) as (a, b, bp)."""
    for batch in batches:
        s = [len(np.intersect1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        bp = np.array(s, np.int64) * 20000 // batch.column(4).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bp)], names=["a", "b", "bp"])


def _scored(met: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Of candidates (a, b, na, nb) those that are near when counted in full, with ``bp``."""
    both = met.join(sets.select(F.col("k").alias("a"), F.col("d").alias("x")), "a").join(sets.select(F.col("k").alias("b"), F.col("d").alias("y")), "b")
    return both.select("a", "b", "x", "y", (F.col("na") + F.col("nb")).alias("total")).mapInArrow(_common, "a bigint, b bigint, bp bigint").where(F.col("bp") >= least)


def _enough_met(met: DataFrame, least: int) -> DataFrame:
    """Of rows (a, b, na, nb), one for each token on which two multisets meet, the pairs that meet on as many as a near pair must.

    Of the two, one's prefix ends first; beyond it no more can be shared than
    that multiset has left.
    """
    pairs = met.where(size_bound(F.col("na"), F.col("nb"), least)).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("_c"))
    shared = F.ceil((F.col("na") + F.col("nb")) * least / F.lit(20000))
    return pairs.where(F.col("_c") >= shared + 1 - F.greatest(_needed(F.col("na"), least), _needed(F.col("nb"), least))).select("a", "b", "na", "nb")


def _starred(prefix: DataFrame, least: int) -> DataFrame:
    """Candidates (a, b, na, nb): each member of a token's bucket with its least member, where they meet often enough there."""
    hubs = prefix.groupBy("t").agg(F.min(F.struct("k", "n")).alias("h"))
    met = prefix.join(hubs, "t").where("k > h.k").select(F.col("h.k").alias("a"), F.col("k").alias("b"), F.col("h.n").alias("na"), F.col("n").alias("nb"))
    return _enough_met(met, least)


def _open(prefix: DataFrame, parts: DataFrame) -> DataFrame:
    """k, t, n, p, _m: rows of buckets that hold several components (p), with the bucket's largest (_top) and its number of members."""
    held = prefix.join(parts.select(F.col("node").alias("k"), "component"), "k", "left").withColumn("p", F.coalesce("component", "k")).drop("component")
    counts = held.groupBy("t", "p").agg(F.count(F.lit(1)).alias("_n"))
    largest = counts.groupBy("t").agg(F.max_by("p", F.struct("_n", "p")).alias("_top"), F.count(F.lit(1)).alias("_parts"), F.sum("_n").alias("_m")).where("_parts > 1")
    return held.join(largest.select("t", "_top", "_m"), "t")


def _across(prefix: DataFrame, parts: DataFrame, least: int) -> DataFrame:
    """Candidates that meet often enough and share no component yet, and no bucket of more than LIGHT members; of those ``_in_blocks`` compares all.

    A bucket whose members are of one component gives none.
    """
    mixed = staged(_open(prefix, parts).where(F.col("_m") <= LIGHT))
    rest = mixed.where("p <> _top").select("t", F.col("k").alias("_x"), F.col("n").alias("_nx"), F.col("p").alias("_px"))
    met = rest.join(mixed, "t").where((F.col("_px") != F.col("p")) & ((F.col("p") == F.col("_top")) | (F.col("_x") < F.col("k"))))  # each pair once a bucket
    swap = F.col("_x") > F.col("k")
    side = lambda x, y, name: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name)
    return _enough_met(met.select(side("_x", "k", "a"), side("k", "_x", "b"), side("_nx", "n", "na"), side("n", "_nx", "nb")), least)


def _dealt(docs: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Multisets (k, g, p) by groups (g), a group of more than ``block`` of them or of BLOCK_BYTES as pairs of blocks (lo, hi); small groups share a task's cell."""
    docs = docs.join(sets.select("k", "n", "d"), "k")
    sizes = docs.groupBy("g").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(block)), F.ceil(F.sum(F.length("d")) / F.lit(BLOCK_BYTES))).cast("int").alias("blocks"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    cells = 1 + sets.count() // block
    docs = docs.join(sizes, "g").withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    docs = docs.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("g"), F.lit(cells)))
    return docs.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other"), "cell": cell, "own": F.when(F.col("blocks") > 1, F.col("g"))})


def _near_within(least: int, across: bool):
    """An applyInArrow function over a cell: pairs (a, b, bp) of each group; of a pair of blocks those of different blocks.

    With ``across`` those that join components, no more than that takes.
    """

    def group(k, n, part, block, packed, two, out):
        of = np.append(0, np.cumsum([len(x) // 8 for x in packed]))
        flat = np.unique(np.frombuffer(b"".join(packed), np.int64), return_inverse=True)[1].astype(np.int32)
        marked = np.zeros(int(flat.max()) + 1, bool)
        _, part, held = np.unique(part, return_inverse=True, return_counts=True)
        asks = np.flatnonzero(part != np.argmax(held)) if across else np.arange(len(k))
        for i in asks:
            if two and not across and block[i]:
                continue
            away = part != part[i] if across else block == 1 if two else np.arange(len(k)) > i
            if not away.any():
                continue
            marked[flat[of[i] : of[i + 1]]] = True
            bp = np.add.reduceat(marked[flat], of[:-1], dtype=np.int64) * 20000 // (n + n[i])
            marked[flat[of[i] : of[i + 1]]] = False
            near = np.flatnonzero(away & (bp >= least))
            if across and len(near):
                near = near[np.unique(part[near], return_index=True)[1]]  # one link to each component
                part[np.isin(part, part[near])] = part[i]
            out.append((np.full(len(near), k[i]), k[near], bp[near]))

    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("g").to_numpy(), kind="stable")
        rows = rows.take(pa.array(order))
        g, k, n, part, block = (rows.column(c).to_numpy() for c in ("g", "k", "n", "p", "block"))
        packed = rows.column("d").to_pylist()
        two = rows.column("lo")[0].as_py() != rows.column("hi")[0].as_py()
        block = (block != rows.column("lo")[0].as_py()).astype(np.int8)
        cuts = np.append(np.flatnonzero(np.append(True, g[1:] != g[:-1])), len(g))
        out = [(np.empty(0, np.int64),) * 3]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            group(k[x:y], n[x:y], part[x:y], block[x:y], packed[x:y], two, out)
        u, v, bp = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"a": np.minimum(u, v), "b": np.maximum(u, v), "bp": bp})

    return run


def _compared(docs: DataFrame, sets: DataFrame, least: int, across: bool, block: int = BLOCK) -> DataFrame:
    dealt = _dealt(docs, sets, block).select("cell", "own", "lo", "hi", "g", "k", "n", "p", "block", "d")
    return dealt.groupBy("cell", "own", "lo", "hi").applyInArrow(_near_within(least, across), "a bigint, b bigint, bp bigint")


def _in_blocks(rows: DataFrame, sets: DataFrame, least: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b, bp) between components (p) of multisets that share a bucket (t, k, p), by their full sets."""
    star = rows.groupBy("t").agg(F.min("k").alias("a"))
    groups = _joined(rows.join(star, "t").select("a", F.col("k").alias("b")).distinct())
    docs = rows.select("k", "p").distinct().join(groups.select(F.col("node").alias("k"), F.col("component").alias("g")), "k")
    return _compared(docs, sets, least, True, block)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links, HERE at most, as every node with the least one it reaches."""
    held = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(2)] for b in batches if b.num_rows]
    if not held:
        return
    a, b = (np.concatenate(x) for x in zip(*held, strict=True))
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    root, before = np.arange(len(nodes)), None
    while before is None or (root != before).any():
        before, low = root.copy(), np.minimum(root[x], root[y])
        for ends in (root[x], root[y], x, y):
            np.minimum.at(root, ends, low)
        root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def _joined(links: DataFrame) -> DataFrame:
    """``components`` of links (a, b); few of them are joined in one task, as rounds of many small tasks would cost more than their work."""
    if links.count() > HERE:
        return components(links)
    return staged(links.coalesce(1).mapInArrow(_finish, "node bigint, component bigint"))


def _families(df: DataFrame, key: str, tokens: Column, least: int, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """node, component: the multisets that have a near one, in their families by single linkage; and the multisets."""
    sets, prefix = _prefixes(df, key, tokens, least, only)
    prefix = staged(prefix)
    links = staged(_scored(_starred(prefix, least), sets, least).select("a", "b"))
    _release(df)
    links = links.unionByName(staged(_scored(_across(prefix, _joined(links), least), sets, least).select("a", "b")))
    wide = staged(_open(prefix, _joined(links)).where(F.col("_m") > LIGHT))
    if not wide.isEmpty():
        _release(df)
        links = links.unionByName(staged(_in_blocks(wide, sets, least).select("a", "b")))
    _release(df)
    return _joined(links), sets


def _numbered(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows with a bigint ``_k`` for their key, and where the key is no whole number the names (_k, key) of these digests."""
    if df.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return df.withColumn("_k", F.col(key).cast("bigint")), None
    numbered = df.withColumn("_k", F.when(F.col(key).isNotNull(), F.xxhash64(key)))
    return numbered, staged(numbered.select("_k", key).distinct())


def _named(found: DataFrame, names: DataFrame | None, kind: str, *columns: str) -> DataFrame:
    """Numbers of ``_numbered`` as the keys they stand for."""
    for c in columns:
        if names is None:
            found = found.withColumn(c, F.col(c).cast(kind))
        else:
            found = found.join(names.toDF("_k", "_name"), F.col(c) == F.col("_k")).withColumn(c, F.col("_name")).drop("_k", "_name")
    return found


def near_pairs(df: DataFrame, key: str, tokens: Column, least: int = NEAR, body: Column | None = None) -> DataFrame:
    """a, b, bp: pairs (a < b) of multisets with a Dice coefficient of at least ``least``.

    Every pair is asked for, so a family of n near copies gives n squared; where
    the families are enough, ``near_families`` doesn't list them.  A near pair
    lies within one family by single linkage, so families are found first and
    their members compared in blocks.  With ``body`` only the least key of each
    of its values counts.
    """
    df, names = _numbered(df.select("*", tokens.alias("_t")), key)
    only = None
    if body is not None:
        df, _, only = _one_each(df, body)
    parts, sets = _families(df, "_k", F.col("_t"), least, only)
    docs = parts.select(F.col("node").alias("k"), F.col("component").alias("g"), F.col("component").alias("p"))
    found = _named(_compared(docs, sets, least, False), names, df.schema[key].dataType.simpleString(), "a", "b")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "bp")


def linked(df: DataFrame, key: str, tokens: Column, least: int = NEAR) -> DataFrame:
    """node, component: the multisets that have a near one, in their families by single linkage.

    Stars first: in each token's bucket all are compared with the least member.
    What that leaves in several components is then compared across them, so no
    link that joins two families is lost, and a family of n near copies costs
    n comparisons for each of its tokens where its hub is near to all of them.
    """
    kind = df.schema[key].dataType.simpleString()
    df, names = _numbered(df.select(key, tokens.alias("_t")), key)
    parts = _named(_families(df, "_k", F.col("_t"), least)[0], names, kind, "node", "component")
    if names is None:
        return parts
    return parts.withColumn("component", F.min("node").over(Window.partitionBy("component")))


def _one_each(df: DataFrame, body: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows with ``_k`` and ``_t``: those to compare, all rows' (_k, _head), and the heads (k), the least of each body."""
    rows = df.withColumn("_d", F.sha2(body, 256)).where("_d is not null")
    pairs = staged(rows.select("_k", "_d"))
    head = pairs.groupBy("_d").agg(F.min("_k").alias("_head")).where("_head is not null")
    members = staged(pairs.join(head, "_d").select("_k", "_head"))
    if not pairs.groupBy("_k").count().where("count > 1").isEmpty():  # an id that repeats counts by the bodies that it is the least of
        rows = rows.join(head.withColumnRenamed("_d", "_e"), (F.col("_d") == F.col("_e")) & (F.col("_k") == F.col("_head"))).dropDuplicates(["_k", "_d"])
    return rows, members, members.select(F.col("_head").alias("k")).distinct()


def near_families(df: DataFrame, key: str, body: Column, tokens: Column, least: int = NEAR) -> DataFrame:
    """key, family, size: families of near copies by single linkage; copies of a body count, one of them is compared."""
    numbered, names = _numbered(df.select("*", tokens.alias("_t")), key)
    rows, members, only = _one_each(numbered, body)
    parts, _ = _families(rows, "_k", F.col("_t"), least, only)
    named = members.join(parts, members["_head"] == parts["node"], "left").select(F.col("_k").alias(key), F.coalesce("component", "_head").alias("family"))
    sizes = named.groupBy("family").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    found = named.join(sizes, "family").select(key, "family", "size")
    if names is None:
        return _named(found, None, df.schema[key].dataType.simpleString(), key, "family")
    found = found.select(F.col(key).alias("_own"), "family", "size")
    found = _named(found, names, "", "_own")
    return found.select(F.col("_own").alias(key), F.min("_own").over(Window.partitionBy("family")).alias("family"), "size")


def differing(left: Column, right: Column) -> Column:
    """The distinct pairs in which two aligned arrays differ; null where they don't align."""
    pairs = F.filter(F.arrays_zip(left.alias("l"), right.alias("r")), lambda x: ~x["l"].eqNullSafe(x["r"]))
    return F.when(F.size(left) == F.size(right), F.array_distinct(pairs))


def renamed_alike(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys: groups in which every a goes with one b and every b with one a."""
    one = lambda x, y: pairs.groupBy(*keys, x).agg(F.min(y).alias("_lo"), F.max(y).alias("_hi")).where("not (_lo <=> _hi)").select(*keys)
    return pairs.select(*keys).distinct().join(one(a, b).unionByName(one(b, a)).distinct(), keys, "left_anti")


def _standing_twice(places: DataFrame) -> DataFrame:
    """Of places (k, p, c, left) those whose ``c`` occurs at two or more; counts combine before the shuffle."""
    return places.join(places.groupBy("c").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("c"), "c", "left_semi").select("k", "p", "c", "left")


def _blocks(lines: DataFrame) -> list[DataFrame]:
    """For blocks of 1, 2, 4 ... lines: the places whose block stands elsewhere too, with a name (c) that equal blocks share.

    A block's name comes from those of its halves, the second found by a join
    at its place; blocks that stand once drop out, as longer ones would.
    """
    levels = [staged(_standing_twice(lines))]
    while True:
        half, held = 1 << (len(levels) - 1), levels[-1]
        second = held.select("k", (F.col("p") - half).alias("p"), F.col("c").alias("_d"))
        whole = held.join(second, ["k", "p"]).select("k", "p", F.xxhash64("c", "_d").alias("c"), "left")
        longer = staged(_standing_twice(whole))
        if longer.isEmpty():
            return levels
        levels.append(longer)


def _asking(levels: list[DataFrame], j: int) -> DataFrame:
    """Places (state, size, asks) that share a block of level j with a place whose run ends before twice that block.

    No run begins where all places of its block follow the same line: a longer
    one holds it.  So copies of whole files ask at their first line alone.
    """
    held = levels[j]
    ends = held.join(levels[j + 1].select("k", "p"), ["k", "p"], "left_anti") if j + 1 < len(levels) else held
    before = held.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.count("left").alias("m"), F.min("left").alias("lo"), F.max("left").alias("hi"))
    asked = ends.join(before.where("m < n or lo <> hi").select("c"), "c", "left_semi").select("k", "p", F.lit(True).alias("_asks"))
    marked = held.join(asked, ["k", "p"], "left").select("k", "p", "left", F.col("c").alias("state"), F.lit(1 << j).alias("size"), F.coalesce("_asks", F.lit(False)).alias("asks"))
    return _where_asked(marked)


def _where_asked(places: DataFrame) -> DataFrame:
    return places.join(places.groupBy("state").agg(F.max("asks").alias("_any")).where("_any").select("state"), "state", "left_semi")


def _run_places(rows: DataFrame, key: str, line: str, symbol: Column, least: int) -> DataFrame:
    """k, p, left, state, size, asks: all places of runs, a run's places sharing its state; those that ask have it as their longest.

    Prefix doubling names all blocks of 1, 2, 4 ... lines that stand twice.  A
    place's run is at least its longest such block and less than two of them;
    from there half steps go down to one line, each kept if what they reach
    stands twice.  Places that can't take a step stay for the shorter ones,
    together with all that share their block, while any of them asks.  All
    are equi-joins and counts, so no text moves and no run gathers its places.
    """
    lines = rows.select(F.col(key).alias("k"), F.col(line).cast("int").alias("p"), symbol.alias("_s")).where("k is not null and p is not null and _s is not null")
    lines = lines.select("k", "p", F.xxhash64("_s").alias("c")).dropDuplicates(["k", "p"])
    order = Window.partitionBy("k").orderBy("p")
    lines = lines.withColumn("left", F.when(F.lag("p").over(order) == F.col("p") - 1, F.lag("c").over(order)))
    levels = _blocks(staged(lines))
    open_places = None
    for j in range(len(levels) - 1, -1, -1):
        if open_places is not None:  # a step of the block of level j
            further = levels[j].select("k", F.col("p").alias("_at"), F.col("c").alias("_d"))
            reached = open_places.withColumn("_at", F.col("p") + F.col("size")).join(further, ["k", "_at"], "left")
            reached = staged(reached.select("k", "p", "left", "state", "size", "asks", F.when(F.col("_d").isNotNull(), F.xxhash64("state", "_d")).alias("_e")))
            twice = reached.where("_e is not null").groupBy("_e").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_e", F.lit(True).alias("_goes"))
            went = reached.join(twice, "_e", "left").withColumn("_goes", F.coalesce("_goes", F.lit(False)))
            stay = went.select("k", "p", "left", "state", "size", (F.col("asks") & ~F.col("_goes")).alias("asks"))
            go = went.where("_goes").select("k", "p", "left", F.col("_e").alias("state"), (F.col("size") + (1 << j)).alias("size"), "asks")
            open_places = _where_asked(stay.unionByName(go))
        if 2 << j > least:
            fresh = _asking(levels, j)
            open_places = fresh if open_places is None else open_places.unionByName(fresh.select(open_places.columns))
    if open_places is None:
        return rows.sparkSession.createDataFrame([], f"k {rows.schema[key].dataType.simpleString()}, p int, left bigint, state bigint, size int, asks boolean")
    return staged(open_places)


def _maximal(open_places: DataFrame, least: int) -> DataFrame:
    """Places that ask for a run of ``least`` lines and more, if no other site of it has the same line before; with its number of ``sites``."""
    sites = open_places.groupBy("state").agg(F.count(F.lit(1)).alias("sites"))
    alike = open_places.where("left is not null").groupBy("state", "left").agg(F.count(F.lit(1)).alias("_alike"))
    asked = open_places.where((F.col("asks")) & (F.col("size") >= least)).join(sites, "state").join(alike, ["state", "left"], "left")
    return asked.where("left is null or _alike = 1")


def repeated_runs(rows: DataFrame, key: str, line: str, symbol: Column, least: int = 3) -> DataFrame:
    """key, first, lines, sites: the longest run from each place that stands elsewhere too, if it can't begin earlier.

    A run has at least ``least`` lines, of consecutive numbers.  ``sites``
    counts the places where it stands, this one included; it is left out where
    another site of it has the same line before.  Null keys, line numbers and
    symbols are no lines; of rows that share a place any one may count.
    """
    found = _maximal(_run_places(rows, key, line, symbol, least), least)
    return found.select(F.col("k").alias(key), F.col("p").alias("first"), F.col("size").alias("lines"), "sites")


def run_sites(rows: DataFrame, key: str, line: str, symbol: Column, least: int = 3) -> DataFrame:
    """run, key, first, lines: every site of each run that ``repeated_runs`` names at one place or more."""
    places = _run_places(rows, key, line, symbol, least)
    named = _maximal(places, least).select("state").distinct()
    return places.join(named, "state", "left_semi").select(F.col("state").alias("run"), F.col("k").alias(key), F.col("p").alias("first"), F.col("size").alias("lines"))


def lines_saved(lines: Column, sites: Column, kind: Column) -> Column:
    """Lines that merging a repeat saves: all but one copy, less a call at each place and, for a new function, its frame."""
    frame = F.when(kind == "function", 3).when(kind == "table", 1).otherwise(2)
    return F.greatest(F.lit(0), lines * (sites - 1) - sites - frame)


def _settle(rows):
    """Rounds: of one stretch's repeats, those that lead on every line they hold stay, and go with all that overlap them, until none is left."""
    import numpy as np

    rows = rows.sort_values(["saves", "sites", "first", "lines"], ascending=[False, True, True, False]).reset_index(drop=True)
    begin = (rows["first"] - rows["first"].min()).to_numpy()
    end = begin + rows["lines"].to_numpy()
    stays = np.zeros(len(rows), bool)
    open_ranks = np.arange(len(rows))
    while len(open_ranks):
        leader = np.full(end.max(), -1)
        for r in open_ranks[::-1]:
            leader[begin[r] : end[r]] = r
        led = np.array([(leader[begin[r] : end[r]] == r).all() for r in open_ranks])
        stays[open_ranks[led]] = True
        held = np.zeros(end.max(), bool)
        for r in open_ranks[led]:
            held[begin[r] : end[r]] = True
        open_ranks = np.array([r for r in open_ranks[~led] if not held[begin[r] : end[r]].any()], int)
    return rows[stays]


def settle(repeats: DataFrame, key: str) -> DataFrame:
    """Repeats (key, first, lines, sites, saves) chosen greedily, most saved first, so that none shares a line.

    The choice is sequential by nature; each stretch of overlapping repeats is
    one group, so a task holds no more than one stretch of one file.
    """
    w = Window.partitionBy(key).orderBy("first", "lines")
    reach = F.max(F.col("first") + F.col("lines")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = repeats.withColumn("_new", F.when(F.col("first") >= F.coalesce(reach, F.lit(-1)), 1).otherwise(0))
    grouped = marked.withColumn("_part", F.sum("_new").over(w)).drop("_new")
    return grouped.groupBy(key, "_part").applyInPandas(_settle, grouped.schema).drop("_part")


def tandem(rows: DataFrame, key: str, start: str, length: str) -> DataFrame:
    """keys of repeats each of whose copies begins where the one before ended."""
    w = Window.partitionBy(key).orderBy(start)
    nxt = F.lead(start).over(w)
    held = rows.withColumn("_ok", nxt.isNull() | (nxt == F.col(start) + F.col(length)))
    return held.groupBy(key).agg(F.bool_and("_ok").alias("_all"), F.count(F.lit(1)).alias("_n")).where("_all and _n > 1").select(key)
