"""Writers: tables replaced by pointer, report documents, annotations."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer changed the table after it was read."""


_POINTER = re.compile(r"version-(\d{12})")


def _folder(spark: SparkSession, path: str):
    if "://" not in path and not path.startswith(("/", "file:")):
        raise ValueError(f"not an absolute path: {path}")
    jvm = spark.sparkContext._jvm
    at = lambda *name: jvm.org.apache.hadoop.fs.Path("/".join((path.rstrip("/"), *name)))
    return jvm, at, at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _told(files, where) -> str | None:
    """What a pointer names; null while its writer hasn't finished it, or died before."""
    stream = files.open(where)
    try:
        raw = bytes(stream.readNBytes(4096))
    finally:
        stream.close()
    return raw[:-1].decode() if raw.endswith(b"\n") else None


def table_version(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """The number of the table's current version, and its data folder; (0, null) if there is none."""
    _, at, files = _folder(spark, path)
    if not files.exists(at()):
        return 0, None
    numbers = sorted((int(m[1]) for m in (_POINTER.fullmatch(s.getPath().getName()) for s in files.listStatus(at())) if m), reverse=True)
    for number in numbers:
        named = _told(files, at(f"version-{number:012}"))
        if named is not None:
            return number, named
    return 0, None


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table that ``replace_table`` wrote; versions that come later don't change what was read."""
    number, named = table_version(spark, path)
    if named is None:
        raise FileNotFoundError(f"no table at {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/{named}")


def _point(spark: SparkSession, path: str, number: int, named: str) -> bool:
    """Make a version the current one, by a file that must not exist yet; false if another writer made that number."""
    jvm, at, files = _folder(spark, path)
    try:
        stream = files.create(at(f"version-{number:012}"), False)
    except Exception as e:  # the file system's own exception types differ
        if files.exists(at(f"version-{number:012}")):
            return False
        raise OSError(f"{path} can't be pointed at {named}") from e
    try:
        stream.write(bytearray(f"{named}\n".encode()))
    finally:
        stream.close()
    return True


def replace_table(df: DataFrame, path: str, expected: int | None = None) -> int:
    """Write a table's next version and make it the current one; returns its number.

    Data goes to a folder of its own that never changes, and a small numbered
    file, made only if there is none of that number, names it.  Readers follow
    the highest finished one, so they see the old table or the new one and at no
    moment none.  With ``expected``, the number of the version that was read, a
    writer that came first is a ``Conflict``; else the later one counts.
    Folders of versions that nobody needs any more go by ``forget_versions``.
    """
    spark = df.sparkSession
    _folder(spark, path)
    named = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path.rstrip('/')}/{named}")
    _, at, files = _folder(spark, path)
    number = table_version(spark, path)[0] if expected is None else expected
    while True:
        number += 1
        if _point(spark, path, number, named):
            return number
        if expected is not None:
            files.delete(at(named), True)
            raise Conflict(f"{path} has a version {number} already")


def forget_versions(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove all but the newest ``keep`` versions, data and pointers; returns how many went.  Data that no pointer names yet stays."""
    _, at, files = _folder(spark, path)
    numbers = sorted(int(m[1]) for m in (_POINTER.fullmatch(s.getPath().getName()) for s in files.listStatus(at())) if m)
    gone = numbers[: max(0, len(numbers) - max(1, keep))]
    for number in gone:
        where = at(f"version-{number:012}")
        named = _told(files, where)
        files.delete(where, False)
        if named:
            files.delete(at(named), True)
    return len(gone)


def findings_json(findings: DataFrame) -> DataFrame:
    """value: each finding as a JSON object without null fields, in order of file, line and item; unknown lines first."""
    ordered = findings.orderBy("file", F.asc_nulls_first("line"), F.asc_nulls_first("item"))
    return ordered.select(F.to_json(F.struct(*findings.columns)).alias("value"))


def annotations(findings: DataFrame, key: str = "gate", shown: int = 10) -> DataFrame:
    """gate, file, line, message: the first findings of each gate, and one row that counts the rest."""
    w = Window.partitionBy(key).orderBy("file", F.asc_nulls_first("line"), "message")
    some = findings.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= shown).select(key, "file", "line", "message")
    more = findings.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shown)
    rest = more.select(key, F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), F.concat(F.lit("and "), (F.col("n") - shown).cast("string"), F.lit(" more")).alias("message"))
    return some.unionByName(rest)
