"""Tool output and documents: JSON, JSON lines, coverage records, listings, diagnostics, unified logs, TOML and YAML.

Closed documents are read with a schema and refuse what it doesn't know; open
ones are read for the fields that a measure needs.  A reader that meets a line
it can't read says so in a row instead of leaving it out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sequences import lines


def json_lines(rows: DataFrame, key: str, schema: str) -> DataFrame:
    """key, line, value, error: each line of ``rows`` (key, line, text) as a struct; ``error`` names lines that don't fit; blank lines are left out."""
    value = F.from_json("text", schema + ", _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    held = rows.where(F.trim("text") != "").select(key, "line", value.alias("value"))
    return held.withColumn("error", F.when(F.col("value._broken").isNotNull() | F.col("value").isNull(), F.concat(F.lit("line "), F.col("line").cast("string"))))


def document(spark: SparkSession, path: str, schema: str, version: int) -> DataFrame:
    """A whole versioned JSON document with ``refused``: why it can't be read (a later version, or not the schema)."""
    read = spark.read.option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").schema(schema + ", _broken string").json(path)
    why = F.when(F.col("_broken").isNotNull(), "not the expected document").when(F.col("version") > version, "written by a later version")
    return read.withColumn("refused", why).drop("_broken")


def coverage(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(file, line, times) and (file, found, hit) of coverage reports given as lines (key, line, text).

    The file name stands in a record's first line and holds to its end marker.
    """
    w = Window.partitionBy(key).orderBy("line")
    record = F.sum(F.when(F.lag("text").over(w) == "end_of_record", 1).otherwise(0)).over(w)
    named = rows.withColumn("_record", record)
    file = F.max(F.when(F.startswith("text", F.lit("SF:")), F.substr(F.col("text"), F.lit(4)))).over(Window.partitionBy(key, "_record"))
    named = named.withColumn("file", file).where("file is not null")
    part = lambda pattern, i: F.regexp_extract("text", pattern, i).try_cast("bigint")
    data = r"^DA:(\d+),(\d+)"
    hits = named.where(F.startswith("text", F.lit("DA:"))).select("file", part(data, 1).cast("int").alias("line"), part(data, 2).alias("times"))
    totals = named.groupBy("file", key, "_record").agg(F.max(part(r"^LF:(\d+)", 1)).alias("found"), F.max(part(r"^LH:(\d+)", 1)).alias("hit"))
    return hits, totals.groupBy("file").agg(F.sum("found").alias("found"), F.sum("hit").alias("hit"))


def missed_lines(hits: DataFrame, totals: DataFrame) -> DataFrame:
    """file, missed: lines that no record executed; where a file has no line records, what its summary leaves."""
    by_line = hits.groupBy("file", "line").agg(F.bool_or(F.col("times") > 0).alias("ran"))
    missed = by_line.groupBy("file").agg(F.count(F.when(~F.col("ran"), 1)).alias("missed"))
    rest = totals.join(missed.select("file"), "file", "left_anti").select("file", F.greatest(F.lit(0), F.col("found") - F.col("hit")).alias("missed"))
    return missed.unionByName(rest)


def blocks(rows: DataFrame, key: str, header: str, item: str = r"^\s+(\S+)\s*$") -> DataFrame:
    """key, head, item: indented items under the last header line; a blank line ends a block."""
    w = Window.partitionBy(key).orderBy("line")
    blank = F.trim("text") == ""
    head = F.when(blank, "").when(F.regexp_extract("text", header, 1) != "", F.regexp_extract("text", header, 1))
    held = rows.withColumn("head", F.last_value(head, ignoreNulls=F.lit(True)).over(w)).withColumn("item", F.regexp_extract("text", item, 1))
    return held.where("head <> '' and item <> ''").select(key, "head", "item")


def diagnostics(rows: DataFrame, key: str, note: str = r"^(?:warning|error)[^:]*: (.*)$", at: str = r"^\s*--> ([^:]+):(\d+)") -> DataFrame:
    """key, message, file, line: a note with the place that the next pointing line gives."""
    w = Window.partitionBy(key).orderBy("line")
    said = F.when(F.regexp_extract("text", note, 1) != "", F.regexp_extract("text", note, 1))
    held = rows.withColumn("message", F.last_value(said, ignoreNulls=F.lit(True)).over(w)).withColumn("_n", F.count(said).over(w))
    found = held.where(F.regexp_extract("text", at, 1) != "").select(key, "message", F.regexp_extract("text", at, 1).alias("file"), F.regexp_extract("text", at, 2).cast("int").alias("at"), "line", "_n")
    first = found.groupBy(key, "_n").agg(F.min(F.struct("line", "message", "file", "at")).alias("f"))
    return first.select(key, "f.message", "f.file", F.col("f.at").alias("line"))


def versioned_names(rows: DataFrame, key: str) -> DataFrame:
    """name, version, refused: a listing of ``name vX`` lines; one bad line refuses all (``refused`` on every row)."""
    pattern = r"^(\S+) v(\d\S*)(?: .*)?$"
    held = rows.where(F.trim("text") != "").select(key, F.regexp_extract("text", pattern, 1).alias("name"), F.regexp_extract("text", pattern, 2).alias("version"))
    flag = held.groupBy(key).agg(F.bool_or(F.col("name") == "").alias("refused"))
    return held.join(flag, key).where("name <> '' or refused").select(key, "name", "version", "refused")


def separated_log(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, id, message: entries ended by a zero character, each an id, a one character and a message."""
    parts = F.filter(F.split(text, "\u0000"), lambda x: F.trim(x) != "")
    return texts.select(key, F.explode(parts).alias("e")).select(key, F.trim(F.substring_index("e", "\u0001", 1)).alias("id"), F.substr(F.col("e"), F.instr("e", "\u0001") + 1).alias("message"))


def added_lines(rows: DataFrame, key: str) -> DataFrame:
    """key, commit, path, at, text: lines that a unified log adds, numbered from their hunk's header.

    Commit and path hold until the next of their kind; a hunk ends when its
    count of new lines is reached, so text that looks like a header inside a
    hunk is text.
    """
    w = Window.partitionBy(key).orderBy("line")
    t = F.col("text")
    start, count = F.regexp_extract(t, r"^@@ -\d+(?:,\d+)? \+(\d+)", 1), F.regexp_extract(t, r"^@@ -\d+(?:,\d+)? \+\d+,(\d+)", 1)
    hunk = t.rlike(r"^@@ -\d+(?:,\d+)? \+\d+")
    carry = lambda c: F.last_value(c, ignoreNulls=F.lit(True)).over(w)
    held = rows.withColumn("_hunk", F.sum(F.when(hunk, 1).otherwise(0)).over(w))
    held = held.withColumns({
        "commit": carry(F.when(t.rlike(r"^commit [0-9a-f]{7,64}\b"), F.regexp_extract(t, r"^commit ([0-9a-f]+)", 1))),
        "path": carry(F.when(t.rlike(r"^\+\+\+ "), F.regexp_extract(t, r"^\+\+\+ (?:b/)?(.*)$", 1))),
        "_start": carry(F.when(hunk, start.cast("int"))),
        "_count": carry(F.when(hunk, F.coalesce(count.try_cast("int"), F.lit(1)))),
    })
    inner = Window.partitionBy(key, "_hunk").orderBy("line")
    new = F.when(~hunk & t.rlike(r"^[+ ]|^$"), 1).otherwise(0)
    held = held.where("_hunk > 0").withColumn("_n", F.sum(new).over(inner))
    inside = (F.col("_n") >= 1) & (F.col("_n") <= F.col("_count"))
    return held.where(inside & F.startswith("text", F.lit("+"))).select(key, "commit", "path", (F.col("_start") + F.col("_n") - 1).alias("at"), F.substr(t, F.lit(2)).alias("text"))


def edges_from_metadata(rows: DataFrame, text: str) -> DataFrame:
    """src, dst, kind: dependencies from workspace metadata as JSON; kinds null (normal), dev and build apart."""
    schema = "packages array<struct<id:string,name:string,dependencies:array<struct<name:string,kind:string>>>>"
    held = rows.select(F.explode(F.from_json(text, schema)["packages"]).alias("p"))
    return held.select(F.col("p.name").alias("src"), F.explode("p.dependencies").alias("d")).select("src", F.col("d.name").alias("dst"), F.coalesce("d.kind", F.lit("normal")).alias("kind"))


def _toml(text: str) -> list[tuple[str, str]]:
    import tomllib

    out: list[tuple[str, str]] = []

    def walk(at: str, value) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                walk(f"{at}.{k}" if at else k, v)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                walk(f"{at}[{i}]", v)
        else:
            out.append((at, str(value).lower() if isinstance(value, bool) else str(value)))

    walk("", tomllib.loads(text))
    return out


MOST_NODES = 100_000


def _yaml(text: str) -> list[tuple[str, str]]:
    """Leaves of a small block-style YAML text: mappings, lists, scalars, quotes and comments; no anchors or flow style."""
    out: list[tuple[str, str]] = []
    stack: list[list] = [[-1, "", 0]]  # indent, path, next list index
    for raw in text.split("\n"):
        line = raw.rstrip()
        body = line.lstrip(" ")
        if not body or body.startswith("#") or body == "---":
            continue
        indent = len(line) - len(body)
        while body.startswith("- ") or body == "-":
            while stack[-1][0] > indent or (stack[-1][0] == indent and not stack[-1][1].endswith("]")):
                stack.pop()
            if stack[-1][0] == indent and stack[-1][1].endswith("]"):
                stack.pop()
            top = stack[-1]
            path = f"{top[1]}[{top[2]}]"
            top[2] += 1
            stack.append([indent, path, 0])
            rest = body[1:]
            body = rest.lstrip(" ")
            indent += 1 + len(rest) - len(body)
        if not body:
            continue
        name, colon, value = body.partition(":")
        if colon and (not value or value.startswith(" ")) and not body.startswith(('"', "'")):
            while stack[-1][0] >= indent:
                stack.pop()
            path = f"{stack[-1][1]}.{name}" if stack[-1][1] else name
            value = value.strip()
            if value and not value.startswith("#"):
                out.append((path, _scalar(value)))
            else:
                stack.append([indent, path, 0])
        else:
            out.append((stack[-1][1], _scalar(body)))
        if len(out) > MOST_NODES:
            raise ValueError(f"more than {MOST_NODES} nodes")
    return out


def _scalar(value: str) -> str:
    if value[:1] in "\"'" and value[:1]:
        end = value.find(value[0], 1)
        return value[1:end] if end > 0 else value[1:]
    return value.split(" #")[0].strip()


def leaves(df: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """key, place, value, error: the leaves of TOML or YAML texts; a text that can't be read gives one row with its error."""
    parse = {"toml": _toml, "yaml": _yaml}[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch["k"], batch["t"], strict=True):
                try:
                    rows += [(k, place, value, None) for place, value in parse(t or "")]
                except ValueError as e:
                    rows.append((k, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["k", "place", "value", "error"])

    kind_of = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind_of}, place string, value string, error string")
    return out.withColumnRenamed("k", key)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line, text: the lines of text files, numbered within each file."""
    whole = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("path"), "value")
    return lines(whole, "path", "value")
