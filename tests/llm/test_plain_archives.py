import base64
import hashlib

from tallyspan.llm import warc


def test_a_plain_file_in_many_splits(spark, tmp_path):
    want, raw = [], {"a": b"", "b": b""}
    for i in range(60):
        body = (b"line %d\r\n\r\n" % i) * (i * 7)
        block = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + body
        record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <%d>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % (i, len(block)) + block + b"\r\n\r\n"
        raw["ab"[i % 2]] += record
        want.append((f"<{i}>", len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()))
    for name, data in raw.items():
        (tmp_path / f"{name}.warc").write_bytes(data)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        found = warc.read_records(spark, f"file://{tmp_path}").select("record_id", "payload_bytes", "payload_digest").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert sorted(tuple(x) for x in found) == sorted(want)
