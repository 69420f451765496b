"""Column selection, shared scratch tables and size estimates for the operators of this package."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where spark.checkpoint.dir is unset, that is in local sessions and tests.
LOCAL_SCRATCH = "file:///tmp/checkpoints"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, by exact name first and then without regard to case.

    Columns are taken by position, so other columns whose names differ only in
    case, or that repeat a name, can neither clash nor be read by mistake.  A
    column that is absent is an error: missing input must not look like a clean result.
    """
    have = df.columns
    flat = df.toDF(*[f"_c{i}" for i in range(len(have))])
    lowered = [h.lower() for h in have]

    def one(name: str):
        if name in have:
            return F.col(f"_c{have.index(name)}").alias(name)
        if name.lower() in lowered:
            return F.col(f"_c{lowered.index(name.lower())}").alias(name)
        raise ValueError(f"the table has no column {name}; it has {', '.join(have) or 'none'}")

    return flat.select(*[one(n) for n in names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster shares for intermediate tables."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset, and this cluster's machines share no local folder")
        root = held.get() if held.isDefined() else LOCAL_SCRATCH
    return root.rstrip("/")


def _path(spark: SparkSession, where: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    where = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    path = _path(spark, where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return where


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it again; cuts lineage so that lost executors cost no recomputation."""
    spark = df.sparkSession
    where = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(where)
    out = spark.read.schema(df.schema).parquet(where)
    out._scratch = where
    return out


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that nothing holds any more, which else stay until the driver happens to collect its garbage.

    Listeners hold a finished plan for a moment, and files go in the
    background, so this waits a little and collects again.
    """
    for pause in (0.3, 0.7):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def drop(df: DataFrame) -> None:
    """Remove a staged table that nothing will read again."""
    spark = df.sparkSession
    path = _path(spark, df._scratch)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def input_bytes(df: DataFrame, default: int = 1 << 20) -> int:
    """Bytes on disk of the tables that ``df`` reads, by the optimizer's statistics; used to choose counts of buckets, never to choose results.

    Tables are added up, as a join's own estimate is a product.  One of
    unknown size, as local rows are, counts as ``default``.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(size if 0 < size < 1 << 62 else default for size in sizes) or default


def buckets(df: DataFrame, bytes_each: int) -> int:
    """How many buckets keep each at about ``bytes_each`` of input; grows with the input."""
    return max(8, -(-input_bytes(df) // bytes_each))
