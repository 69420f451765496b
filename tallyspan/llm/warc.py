"""WARC archives: writing page captures, reading records back, assembling transactions.

A capture is three records, a request, a response (or a revisit of an equal
payload) and a metadata record; the first and last name the second in
WARC-Concurrent-To.  Archives are written by Spark's text sink and read by its
text source, both with the blank line that ends a WARC record as the line
separator, so any store that Spark reaches will do and no file is ever held in
memory whole; the reader puts records together again by their Content-Length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import pick, scratch_path, stage, table

SEPARATOR = "\r\n\r\n"
_SEP = SEPARATOR.encode()
#: The base32 alphabet of RFC 4648.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def base32_of(hexed: Column) -> Column:
    """A SHA-1 in hex as bare upper-case base32: 4 letters for every 5 hex digits."""
    number = lambda i: F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
    letter = lambda i, j: F.substring(F.lit(ALPHABET), F.shiftright(number(i), 15 - 5 * j) % 32 + 1, F.lit(1))
    return F.concat(*[letter(i, j) for i in range(8) for j in range(4)])


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit("WARC/1.1\r\n")]
    for name, value in [*headers, ("Content-Length", F.octet_length(block).cast("string"))]:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    return F.concat(*lines, F.lit("\r\n"), block)


def write_captures(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """Write one capture per row of ``pages`` (page_id, url, html) as gzipped WARC files under ``path``.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes, those
    with the smallest page_id become responses and the others revisits of
    them.  A null html is an empty payload.  A null url leaves the target
    header out, and line ends in a url are percent-encoded.  A null page_id is
    never the smallest, save where a payload has no other.  Rows that repeat
    page_id and payload are all responses, each a capture of its own.
    """
    pages = pick(pages, "page_id", "url", "html")
    body = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.col("url").cast("string"), "\r", "%0D"), "\n", "%0A").alias("url"),
        body.alias("html"),
        F.octet_length(body).cast("bigint").alias("n_bytes"),
        F.xxhash64(body).alias("mark"),
    )
    # Every payload is digested once, and copies meet as digests; only then does each page's html move, once, by its own id.
    # ``mark`` only tells apart rows that repeat an id.
    each = pages.select("page_id", "mark", "n_bytes", F.sha1(F.col("html").cast("binary")).alias("hexed"))
    hexed = stage(each.groupBy("page_id", "mark", "n_bytes", "hexed").agg(F.count(F.lit(1)).alias("copies")), "warc-digests")
    small = stage(hexed.select("page_id", "mark", "n_bytes", "copies", base32_of(F.col("hexed")).alias("digest")), "warc-letters")
    first = small.where(F.col("n_bytes") >= min_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"))
    decided = small.join(first, "digest", "left").select(F.col("page_id").alias("_id"), F.col("mark").alias("_mark"), "digest", "first_id", "copies")
    keyed = pages.join(decided, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
    # Rows that repeat id and payload are told apart by their place; a revisit then finds them by the digest, as its profile says.
    keyed = keyed.withColumn("_place", F.monotonically_increasing_id())
    own = F.when(F.col("copies") > 1, F.col("_place").cast("string"))
    original = F.col("first_id").isNull() | F.col("page_id").eqNullSafe(F.col("first_id"))
    key = lambda page, kind, *more: _urn(F.coalesce(page.cast("string"), F.lit("null")), F.col("digest"), F.lit(kind), *more)
    main = key(F.col("page_id"), "response", own)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    target, date = ("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(DATE))
    answered = _record(
        [
            ("WARC-Type", F.when(original, "response").otherwise("revisit")),
            ("WARC-Record-ID", main),
            date,
            target,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Profile", F.when(~original, F.lit(PROFILE))),
            ("WARC-Refers-To", F.when(~original, key(F.col("first_id"), "response"))),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.when(original, F.concat(http, F.col("html"))).otherwise(http),
    )
    asked = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", key(F.col("page_id"), "request", own)), date, target, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce("url", F.lit("-")), F.lit(" HTTP/1.1\r\n\r\n")),
    )
    about = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", key(F.col("page_id"), "metadata", own)), date, target, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n")),
    )
    rows = keyed.select(F.concat_ws(SEPARATOR, asked, answered, about).alias("value"))
    rows.write.option("lineSep", SEPARATOR).option("compression", "gzip").text(path)


RECORD = "record_id string, record_type string, target_uri string, date string, concurrent_to array<string>, refers_to string, content_type string, payload_bytes bigint, payload_digest string, fields map<string,string>, payload binary"


def _fields(head: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in head.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and out:  # a folded line
            out[-1] = (out[-1][0], out[-1][1] + " " + line.strip().decode("utf-8", "replace"))
        else:
            name, colon, value = line.partition(b":")
            if colon:
                out.append((name.strip().decode("latin-1").lower(), value.strip().decode("utf-8", "replace")))
    return out


def _parsed(head: bytes, block: bytes, with_payload: bool) -> dict:
    fields = _fields(head)
    one = dict(fields)
    kind, media = one.get("warc-type"), one.get("content-type", "")
    payload, size, digest = block, len(block), None
    if media.startswith("application/http"):
        start, cut, payload = block.partition(_SEP)
        size = len(payload)
        if kind == "revisit":
            told = dict(_fields(start)).get("content-length", "")
            size, digest = int(told) if told.isdigit() else None, one.get("warc-payload-digest")
    if kind != "revisit":
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return {
        "record_id": one.get("warc-record-id"),
        "record_type": kind,
        "target_uri": one.get("warc-target-uri"),
        "date": one.get("warc-date"),
        "concurrent_to": [v for k, v in fields if k == "warc-concurrent-to"],
        "refers_to": one.get("warc-refers-to"),
        "content_type": media,
        "payload_bytes": size,
        "payload_digest": (digest or "").removeprefix("sha1:") or None,
        "fields": dict(_fields(block)) if media == "application/warc-fields" else {},
        "payload": payload if with_payload else None,
    }


def records_of(fragments: Iterator[bytes], with_payload: bool = False) -> Iterator[dict]:
    """Records from the fragments that splitting an archive at every blank line leaves."""
    head: bytes | None = None
    held: list[bytes] = []
    need = size = 0
    for part in fragments:
        if head is None:
            if not part.strip():
                continue
            head, held, size = part.lstrip(), [], -len(_SEP)
            told = dict(_fields(head)).get("content-length", "0")
            need = int(told) if told.isdigit() else 0
            continue
        held.append(part)
        size += len(part) + len(_SEP)
        if size >= need:
            block = _SEP.join(held)
            yield _parsed(head, block[:need], with_payload)
            rest = block[need:].lstrip(b"\r\n")  # a block that ends in a line end is cut early: the next header follows it
            head = None
            if rest:
                head, held, size = rest, [], -len(_SEP)
                told = dict(_fields(head)).get("content-length", "0")
                need = int(told) if told.isdigit() else 0
    if head is not None and held:  # the archive ends inside a record
        yield _parsed(head, _SEP.join(held), with_payload) | {"payload_digest": None}


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per WARC record of the files under ``path`` (plain or gzipped).

    ``payload_bytes`` and ``payload_digest`` are measured on the payload read,
    or for revisits taken from the headers that stand for it.  The payload
    itself comes only when asked for.  A record cut off by the end of its
    archive has a null digest.
    """
    names = [f.split(" ")[0] for f in RECORD.replace("map<string,string>", "map").split(", ")]
    schema = pa.schema(
        [(n, pa.string()) for n in names[:4]]
        + [("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("content_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[bytes]:
            for batch in batches:
                for x in batch.column(0):
                    yield x.as_py() or b""

        rows: list[dict] = []
        weight = 0
        for row in records_of(parts(), with_payload):
            rows.append(row | {"fields": list(row["fields"].items())})
            weight += 500 + len(row["payload"] or b"")
            if weight > 8_000_000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, weight = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((x.as_py(), part.as_py() or b"") for batch in batches for x, part in zip(batch.column(1), batch.column(0), strict=True))
        for _, of_file in groupby(pairs, lambda x: x[0]):
            yield from read(pa.record_batch([pa.array([part], pa.binary())], names=["value"]) for _, part in of_file)

    lines = spark.read.option("lineSep", SEPARATOR).option("recursiveFileLookup", "true").text(path)
    lines = lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    packed = F.lower("file").endswith(".gz")
    # Spark cuts plain files into splits that may begin inside a record: their parts are put in order again, so that one parser reads a file from its start.
    plain = lines.where(~packed).withColumn("place", F.monotonically_increasing_id())
    plain = plain.repartition("file").sortWithinPartitions("file", "block", "place").select("value", "file")
    return lines.where(packed).select("value").mapInArrow(read, RECORD).unionByName(plain.mapInArrow(read_files, RECORD))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, answer, requests, metadata.

    Request and metadata records join the response or revisit that their
    WARC-Concurrent-To names; a link may also point the other way, or go by
    way of a request.  Records that no capture claims are left out of the
    result, as are those without an id; captures without a request or metadata
    have empty arrays.  Captures that share a record id share what names it.
    """
    main = F.col("record_type").isin("response", "revisit", "resource")
    mains, others = records.where(main), records.where(~main & F.col("record_id").isNotNull())
    named = others.select("record_id", "record_type", F.explode("concurrent_to").alias("target"))
    back = mains.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("target"))
    by_way = named.where("record_type = 'request'").select(F.col("record_id").alias("_via"), F.col("target").alias("_then"))
    links = named.drop("record_type").unionByName(back)
    links = links.join(by_way, links["target"] == by_way["_via"], "left").select("record_id", F.coalesce("_then", "target").alias("capture_id")).distinct()
    part = F.struct(*[F.col(c) for c in ("record_type", "record_id", "target_uri", "date", "content_type", "payload_bytes", "fields", "payload")])
    parts = others.select("record_id", part.alias("part")).join(links, "record_id")
    of = lambda kind: F.filter("parts", lambda x: x["record_type"] == kind)
    parts = parts.groupBy("capture_id").agg(F.collect_list("part").alias("parts"))
    answer = F.struct(*[F.col(c) for c in records.columns if c not in ("concurrent_to", "fields")]).alias("answer")
    whole = mains.select(F.col("record_id").alias("_id"), answer).join(parts, F.col("_id") == F.col("capture_id"), "left")
    whole = whole.withColumn("parts", F.coalesce("parts", F.array().cast(parts.schema["parts"].dataType)))
    return whole.select(F.col("_id").alias("capture_id"), "answer", of("request").alias("requests"), of("metadata").alias("metadata"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_captures(table(spark, sf_dir, "pages"), path)
    captures = assemble(stage(read_records(spark, path), "warc-records"))
    page = F.try_element_at(F.element_at("metadata", 1)["fields"], F.lit("pageid")).try_cast("bigint")
    rows = captures.select("capture_id", page.alias("page_id"), "answer.*")
    rows = rows.select("capture_id", "page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").alias("_to"))
    rows = stage(rows, "warc-captures")
    responses = rows.where("record_type = 'response'")
    pages = responses.select(F.col("capture_id").alias("_capture"), F.col("page_id").alias("_page")).distinct()
    by_digest = responses.groupBy(F.col("payload_digest").alias("_digest")).agg(F.min("page_id").alias("_least"))
    out = rows.join(pages, F.col("_to") == F.col("_capture"), "left").join(by_digest, F.col("_to").isNotNull() & (F.col("payload_digest") == F.col("_digest")), "left")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", F.coalesce("_page", "_least").alias("refers_to"))


SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p
)
SELECT page_id, payload_bytes,
  array_to_string([substr('{ALPHABET}', ((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1) for i in range(32)], '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""
