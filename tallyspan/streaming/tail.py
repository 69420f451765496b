"""A streaming source that follows append-only journal files.

The offset is the number of bytes taken from each file, always up to the end of
a line: a partial last line waits until the rest of it is there.  Nothing is
read twice after a restart, as Spark keeps the offsets.  Limits on the number
of files, on a file and on a line are errors, and so is a file that vanishes or
shrinks: a journal that can't be trusted must not look like a quiet one.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Limits of a journal: files in the folder, bytes of a file and of a line.  Fixed values.
FILES, FILE_BYTES, LINE_BYTES = 128, 1_073_741_824, 16_384
#: Bytes of one file that one partition reads; a longer stretch is dealt to several, cut at line ends.
SPLIT_BYTES = 8 << 20


class Stretch(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


def _files(folder: str):
    """The file system of a folder, and the sizes of the plain files in it by path."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return system, {f.path: f.size for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))}


def _line_end(source, first: int, last: int, limit: int) -> int:
    """Where the last whole line between two places ends; a piece longer than ``limit`` without a line end is an error."""
    end = last
    while end > first:
        begin = max(first, end - limit - 1)
        source.seek(begin)
        at = source.read(end - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        if last - begin > limit:
            raise ValueError(f"a line is longer than {limit} bytes")
        end = begin
    return first


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.files, self.file_bytes, self.line_bytes = (int(options.get(name, held)) for name, held in (("files", FILES), ("filebytes", FILE_BYTES), ("linebytes", LINE_BYTES)))
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.taken: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, sizes = _files(self.folder)
        if len(sizes) > self.files:
            raise ValueError(f"there are {len(sizes)} journals, more than {self.files}")
        gone = sorted(self.taken.keys() - sizes.keys())
        if gone:
            raise ValueError(f"a journal was removed: {gone[0]}")
        for path, size in sizes.items():
            first = self.taken.get(path, 0)
            if size > self.file_bytes:
                raise ValueError(f"{path} is longer than {self.file_bytes} bytes")
            if size < first:
                raise ValueError(f"{path} has become shorter")
            if size > first:
                with system.open_input_file(path) as source:
                    self.taken[path] = _line_end(source, first, size, self.line_bytes)
        return dict(self.taken)

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        # After a restart the first batch tells what was taken before.
        self.taken = {p: max(n, self.taken.get(p, 0)) for p, n in end.items()} | {p: n for p, n in self.taken.items() if p not in end}
        out = []
        system, _ = _files(self.folder)
        for path, last in end.items():
            first = start.get(path, 0)
            with system.open_input_file(path) as source:
                while last - first > self.split:
                    cut = _line_end(source, first, first + self.split, self.line_bytes)
                    out.append(Stretch(path, first, cut))
                    first = cut
            if last > first:
                out.append(Stretch(path, first, last))
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        system, _ = _files(self.folder)
        with system.open_input_file(partition.path) as source:
            source.seek(partition.first)
            held = source.read(partition.last - partition.first)
        at = partition.first
        for line in held.split(b"\n")[:-1]:
            if len(line) > self.line_bytes:
                raise ValueError(f"a line is longer than {self.line_bytes} bytes")
            yield partition.path, at, line.decode("utf-8", "replace")
            at += len(line) + 1


class JournalTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "journal_tail"

    def schema(self) -> str:
        return "file string, at bigint, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail(spark: SparkSession, folder: str, **limits: int) -> DataFrame:
    """file, at, line: a stream of the whole lines of the files in a folder, as they grow; ``at`` is the byte where a line begins.

    ``limits`` (files, filebytes, linebytes, splitbytes) replace the fixed ones.
    Empty lines are lines; bytes that aren't UTF-8 stand as replacement characters.
    """
    spark.dataSource.register(JournalTail)
    return spark.readStream.format("journal_tail").options(path=folder, **{k: str(v) for k, v in limits.items()}).load()


def records(lines: DataFrame, schema: str) -> DataFrame:
    """file, at, error and the columns of ``schema``: each line as a JSON record; a line that is none has an ``error`` and nulls."""
    held: Column = F.from_json("line", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    found = lines.select("file", "at", "line", held.alias("r"))
    error = F.when(F.col("r").isNull() | F.col("r._broken").isNotNull(), F.concat(F.lit("no record: "), F.substring("line", 1, 80)))
    names = [part.split()[0] for part in schema.split(", ")]
    return found.select("file", "at", error.alias("error"), *[F.when(error.isNull(), F.col(f"r.{n}")).alias(n) for n in names])
