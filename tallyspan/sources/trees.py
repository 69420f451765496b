"""File trees and their ownership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import in_scope
from ..operators.joins import deepest_owner

#: Directories that no measure enters.
PRUNED = ("target", "node_modules", ".git", "vendor", "__pycache__", ".venv")
BINARY_HEAD = 8000


def listing(spark: SparkSession, root: str, pruned: tuple[str, ...] = PRUNED) -> DataFrame:
    """path (relative, with ``/``), length, content: every file below a root, without pruned directories; an unreadable file is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    place = F.regexp_replace(F.col("path"), r"^[a-z][a-z0-9+.-]*:/+", "/")
    base = "/" + root.split("://")[-1].removeprefix("file:").strip("/") + "/"
    relative = F.substr(place, F.instr(place, F.lit(base)) + len(base))
    inside = F.slice(F.split(relative, "/"), 1, F.greatest(F.size(F.split(relative, "/")) - 1, F.lit(0)))
    rows = files.select(relative.alias("path"), "length", "content")
    return rows.where(~F.arrays_overlap(inside, F.array(*[F.lit(p) for p in pruned])) | (F.size(inside) == 0))


def texts(files: DataFrame) -> DataFrame:
    """path, text: the text of each file, null where it isn't UTF-8."""
    return files.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))


def kept(files: DataFrame, include: list[str], exclude: list[str] = ()) -> DataFrame:
    return files.where(in_scope(F.col("path"), include, list(exclude)))


def without_ignored(files: DataFrame, ignored: DataFrame) -> DataFrame:
    """Files outside the directories of ``ignored`` (dir); meets on every directory above a file."""
    owned = deepest_owner(files.select("path").distinct(), ignored, "path", ignored.columns[0])
    return files.join(owned.where("owner is not null").select("path"), "path", "left_anti")


def is_binary(content) -> F.Column:
    """Whether the first 8,000 bytes hold a zero byte."""
    return F.position(F.lit(b"\x00"), F.substring(content, 1, BINARY_HEAD)) > 0


def tree_digest(files: DataFrame) -> DataFrame:
    """digest: one value for all paths and bytes, whatever the order of files.

    Two sums of independent digests of (path, content) combine before the
    shuffle, so no list of all files is gathered.
    """
    one = F.sha2(F.concat(F.encode("path", "UTF-8"), F.lit(b"\x00"), F.sha2("content", 256).cast("binary")), 256)
    part = lambda a: F.sum(F.conv(F.substring(one, a, 12), 16, 10).cast("decimal(38,0)"))
    return files.agg(F.sha2(F.concat_ws("/", *[part(a).cast("string") for a in (1, 13, 25, 37)], F.count(F.lit(1)).cast("string")), 256).alias("digest"))


def guarded(rows: DataFrame, most: int, what: str) -> DataFrame:
    """n, reason: how many rows there are, and why they can't be used if there are more than ``most``."""
    n = F.count(F.lit(1))
    return rows.agg(n.alias("n"), F.when(n > most, F.lit(f"more than {most} {what}")).alias("reason"))
