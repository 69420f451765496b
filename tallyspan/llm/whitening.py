"""Whitening of embeddings by a tiled covariance.

Each distinct vector of whole numbers counts once.  Its rows are dealt to row
blocks; a row block is cut into column blocks, and every pair of column blocks
meets under a tile key, centred first and then multiplied.  Tasks sum the tiles
they make, and their sums are added as a tree, so a tile never gathers more
than FAN partial sums.  The assembled covariance is as large as the square of
the dimension, whatever the number of rows; the driver takes its eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import pick, stage, table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Columns in a tile at least; a quarter of the dimension where that is more.
TILE = 32
#: Bytes of a column block, which decide the rows of a row block.
BLOCK_BYTES = 512 << 10
#: Bytes of column blocks that a task multiplies, about; partial sums added at once.
TASK_BYTES, FAN = 64 << 20, 32
#: Beyond this an entry, times SCALE, counts as not finite: whole numbers travel as 32 bits.
LARGEST = 2.0**31 - 2
#: Components with less of the largest eigenvalue than this have no spread to scale by.
FLAT = 1e-12

POINT = "vec_id bigint, d int, y binary"


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """floor(SCALE * entry) of every usable vector, as 32-bit numbers."""
    for batch in batches:
        ids, vectors = batch.column(0), batch.column(1)
        keep, size, out = [], [], []
        for i, v in enumerate(vectors):
            if not v.is_valid:
                continue
            entries = v.values
            if entries.null_count:
                continue
            y = np.floor(entries.to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
            if len(y) and not (np.abs(y) <= LARGEST).all():  # also false for what is not a number
                continue
            keep.append(i)
            size.append(len(y))
            out.append(y.astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(size, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "d", "y"])


def points(rows: DataFrame) -> DataFrame:
    """vec_id, d, y: the vectors that can be used, each entry as floor(64 * entry)."""
    rows = pick(rows, "vec_id", "embedding")
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_points, POINT)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """The packed vectors of a column as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, d), np.int32)
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view("<i4").reshape(-1, d)


def _sums(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(d, np.int64), 0
        for batch in batches:
            total += _matrix(batch.column(0), d).sum(axis=0, dtype=np.int64)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(total), pa.array(np.full(d, n))], names=["dim", "s", "n"])

    return run


def _cut(d: int, tile: int):
    """The column blocks of every row block, once for each tile that they are a side of."""
    edges = [*range(0, d, tile), d]
    count = len(edges) - 1
    rows = max(1, BLOCK_BYTES // (4 * tile))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            y = _matrix(batch.column(0), d)
            for begin in range(0, len(y), rows):
                parts = [np.ascontiguousarray(y[begin : begin + rows, edges[i] : edges[i + 1]]).tobytes() for i in range(count)]
                for i in range(count):
                    for j in range(i, count):
                        sides = [0] if i == j else [0, 1]
                        columns = [[block] * len(sides), [i] * len(sides), [j] * len(sides), sides, [parts[j if s else i] for s in sides]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["block", "i", "j", "side", "y"])
                block += 1

    return run


TILES = "i int, j int, task bigint, m binary"
_TILES = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("task", pa.int64()), ("m", pa.binary())])


def _tiles(tiles: dict[tuple[int, int], np.ndarray], task: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in tiles], pa.int32()), pa.array([k[1] for k in tiles], pa.int32()), pa.array([task] * len(tiles), pa.int64()), pa.array([m.tobytes() for m in tiles.values()], pa.binary())], schema=_TILES)


def _multiplied(mean: np.ndarray, tile: int):
    """The products of a task's pairs of column blocks, summed per tile; rows come in order of (block, i, j, side)."""
    d = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[int, int], np.ndarray] = {}
        left = None
        for batch in batches:
            for row in batch.to_pylist():
                i, j = row["i"], row["j"]
                own = j if row["side"] else i
                mid = mean[own * tile : own * tile + tile]
                centred = np.frombuffer(row["y"], "<i4").reshape(-1, len(mid)) - mid
                if i != j and not row["side"]:
                    left = centred
                    continue
                product = (left if i != j else centred).T @ centred
                tiles[i, j] = tiles[i, j] + product if (i, j) in tiles else product
        yield _tiles(tiles, TaskContext.get().partitionId())

    assert tile * len(range(0, d, tile)) >= d
    return run


def _added(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(m) for m in rows.column("m").to_pylist())
    return pa.table([rows.column("i").slice(0, 1), rows.column("j").slice(0, 1), rows.column("task").slice(0, 1), pa.array([total.tobytes()], pa.binary())], schema=_TILES)


def tile_sums(parts: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """The sum of every tile (flat) over tasks, FAN at a time; as many numbers as the tiles have reach the driver."""
    parts = stage(parts, "tiles")
    wide = (parts.agg(F.max("task")).first()[0] or 0) + 1
    while wide > 1:
        step = parts.withColumn("task", F.floor(F.col("task") / F.lit(FAN)).cast("bigint")).groupBy("i", "j", "task").applyInArrow(_added, TILES)
        parts = stage(step, "tiles")
        wide = -(-wide // FAN)
    return {(r["i"], r["j"]): np.frombuffer(r["m"]) for r in parts.collect()}


def covariance(fit: DataFrame, mean: np.ndarray, n: int, tile: int) -> np.ndarray:
    """The covariance (divisor n) of the rows of ``fit`` (y), by tiles."""
    d = len(mean)
    count = len(range(0, d, tile))
    tasks = max(2, -(-n * 4 * d * count // TASK_BYTES))
    # Row blocks and tiles spread over tasks by hash; the two sides of a pair meet in one.
    dealt = fit.mapInArrow(_cut(d, tile), "block bigint, i int, j int, side int, y binary").repartition(tasks, "block", "i", "j").sortWithinPartitions("block", "i", "j", "side")
    out = np.zeros((d, d))
    for (i, j), flat in tile_sums(dealt.mapInArrow(_multiplied(mean, tile), TILES)).items():
        m = flat.reshape(min(tile, d - i * tile), -1)
        out[i * tile : i * tile + tile, j * tile : j * tile + tile] = m
        out[j * tile : j * tile + tile, i * tile : i * tile + tile] = m.T
    return out / n


def _moments(mean: np.ndarray, basis: np.ndarray):
    """Sums and products of the whitened rows of a task; the first column stands for 1."""
    d, k = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            z = (_matrix(batch.column(0), d) - mean) @ basis
            z = np.concatenate([np.ones((len(z), 1)), z], axis=1)
            total += z.T @ z
        yield _tiles({(0, 0): total}, TaskContext.get().partitionId())

    return run


def _deviations(y: np.ndarray, sums: np.ndarray, n: int) -> list[int | None]:
    """The sum of (n * y - sum)^2 of each row, exactly; null where it is beyond a long.  A shift of y changes nothing."""
    most = max(int(np.abs(y).max(initial=0)) * n, int(np.abs(sums).max(initial=0)))
    if most < 1 << 61 and (2 * most) ** 2 * max(1, len(sums)) < 1 << 63:
        return ((y.astype(np.int64) * n - sums) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True)) for row in y]
    return [v if v < 1 << 63 else None for v in exact]


WHITENED = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def _whitened(mean: np.ndarray, basis: np.ndarray, flat: np.ndarray, explained: np.ndarray, sums: np.ndarray, n: int, error: float):
    d, k = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _matrix(batch.column(1), d)
            z = ((y - mean) @ basis).reshape(-1)
            index = pa.array(np.repeat(np.arange(len(y)), k))
            columns = [
                batch.column(0).take(index),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))),
                pa.array(np.full(len(z), n, np.int64)),
                pa.array(_deviations(y, sums, n), pa.int64()).take(index),
                pa.array(z, mask=np.tile(flat, len(y))),
                pa.array(np.tile(explained, len(y))),
                pa.array(np.full(len(z), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in WHITENED.split(", ")])

    return run


def whiten(rows: DataFrame, components: int = COMPONENTS, tile: int | None = None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    Vectors that are null, or hold null or non-finite entries, are left out;
    so are those with an entry beyond 33 million.  The model is fitted on the distinct
    vectors x = floor(64 * entry) + 1000000, each once: n of them.  ``deviation``
    is the exact sum of (n * x - S)^2 over dimensions, null where a long can't
    hold it.  A component without spread (equal vectors, or fewer of them than
    dimensions) has a null ``whitened`` and doesn't count in ``identity_error``.

    Vectors of one dimension are whitened together: the most frequent one, the
    larger of two as frequent; others are left out.  Empty vectors have no
    components.  Rows that repeat, and null ids, give rows of their own.  A
    table without usable vectors gives none.  Other columns are left out.
    """
    spark = rows.sparkSession
    held = stage(points(rows), "points")
    sizes = held.where("d > 0").groupBy("d").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("d")).first()  # one line
    if sizes is None:
        return spark.createDataFrame([], WHITENED)
    d = sizes["d"]
    held = held.where(F.col("d") == d)
    # Equal vectors combine before the shuffle, so one that many rows share costs a row for each task.
    fit = stage(held.select("y").distinct(), "fit-list")
    told = fit.mapInArrow(_sums(d), "dim int, s bigint, n bigint").groupBy("dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("dim").collect()  # d lines
    n, sums = told[0]["n"], np.array([r["s"] for r in told])
    mean = sums / n
    tile = tile or max(TILE, -(-d // 4))
    values, vectors = np.linalg.eigh(covariance(fit, mean, n, tile))
    k = min(components, d)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    explained = (values / (values.sum() or 1.0))[:k]
    flat = values[:k] <= FLAT * values[0]
    basis = np.where(flat, 0.0, vectors[:, :k] / np.sqrt(np.where(flat, 1.0, values[:k])))
    moments = tile_sums(fit.mapInArrow(_moments(mean, basis), TILES))[0, 0].reshape(k + 1, k + 1) / n
    spread = moments[1:, 1:] - np.outer(moments[0, 1:], moments[0, 1:])
    error = float(np.abs(spread - np.diag((~flat).astype(float))).max())
    return held.select("vec_id", "y").mapInArrow(_whitened(mean, basis, flat, explained, sums, n, error), WHITENED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
