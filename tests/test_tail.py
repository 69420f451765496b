"""Streams over growing journals: partial lines, restarts, limits; timers of open invocations and of progress."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tallyspan.streaming import journal, tail

NAMES = [part.split()[0] for part in journal.SCHEMA.split(", ")]


def _line(*event):
    return json.dumps(dict(zip(NAMES, event, strict=False))) + "\n"


def _append(path, text):
    with open(path, "ab") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


def _until(condition, seconds=60):
    end = time.time() + seconds
    while time.time() < end and not condition():
        time.sleep(0.3)
    return condition()


def _taken(spark, folder, checkpoint, name, **limits):
    """One run over what is there: the lines, and the query."""
    q = tail.tail(spark, str(folder), **limits).writeStream.format("memory").queryName(name).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(60)
    if q.exception():
        raise RuntimeError(str(q.exception()))
    return [r["line"] for r in spark.table(name).orderBy("file", "at").collect()]


def test_half_a_line_waits_for_its_rest_and_a_restart_repeats_none(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    _append(folder / "a", "one\ntw")

    def run():
        q = tail.tail(spark, str(folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert q.exception() is None
        return sorted((r["at"], r["line"]) for r in spark.read.parquet(out).collect())

    assert run() == [(0, "one")]
    assert run() == [(0, "one")]
    _append(folder / "a", "o\n\nthr")
    _append(folder / "b", "x\n")
    assert run() == [(0, "one"), (0, "x"), (4, "two"), (8, "")]
    _append(folder / "a", "ee\n")
    assert run() == [(0, "one"), (0, "x"), (4, "two"), (8, ""), (9, "three")]


def test_one_running_query_follows_appends(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    _append(folder / "a", "half")
    q = tail.tail(spark, str(folder)).writeStream.format("memory").queryName("grows").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        time.sleep(2)
        assert spark.table("grows").count() == 0
        _append(folder / "a", " and half\nnext\n")
        assert _until(lambda: spark.table("grows").count() == 2)
    finally:
        q.stop()
    assert sorted(r["line"] for r in spark.table("grows").collect()) == ["half and half", "next"]


def test_long_stretches_are_split_at_line_ends(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [f"line {i}" for i in range(500)]
    _append(folder / "a", "\n".join(lines) + "\n")
    assert _taken(spark, folder, tmp_path / "cp", "split", splitbytes=100, linebytes=20) == lines


@pytest.mark.parametrize(("text", "limits", "why"), [("x" * 50, {"linebytes": 20}, "longer than 20"), ("x" * 50 + "\nok\n", {"linebytes": 20}, "longer than 20"), ("a\n" * 20, {"filebytes": 30}, "longer than 30"), ("a\n", {"files": 0}, "more than 0")])
def test_limits_are_errors(spark, tmp_path, text, limits, why):
    folder = tmp_path / "in"
    folder.mkdir()
    _append(folder / "a", text)
    with pytest.raises(Exception, match=why):
        _taken(spark, folder, tmp_path / "cp", "limited", **limits)


def test_lines_that_are_no_records(spark):
    lines = spark.createDataFrame([("f", 0, _line("a", 0, 0, "header")), ("f", 9, "{broken"), ("f", 20, "")], "file string, at bigint, line string")
    found = {r["at"]: r for r in tail.records(lines, journal.SCHEMA).collect()}
    assert found[0]["error"] is None and found[0]["instance"] == "a" and found[0]["seq"] == 0
    assert found[9]["error"] == "no record: {broken" and found[9]["seq"] is None and found[20]["error"]


def _watching(spark, folder, checkpoint, name, wake, trigger):
    lines = tail.records(tail.tail(spark, str(folder)), journal.SCHEMA)
    out = journal.watch(lines.withColumn("instance", F.coalesce("instance", F.element_at(F.split("file", "/"), -1))), wake=wake)
    return out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(checkpoint)).trigger(**trigger).start()


def test_silent_invocations_become_overdue_one_by_one(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    _append(folder / "q", _line("q", 0, 0, "header") + _line("q", 1, 1, "begin", None, 4, 1500) + _line("q", 2, 2, "begin", None, 5, 6000) + _line("q", 3, 3, "begin", None, 6, 600_000))
    q = _watching(spark, folder, tmp_path / "cp", "silent", True, {"processingTime": "500 milliseconds"})
    try:
        told = lambda: sorted(tuple(r) for r in spark.table("silent").collect())
        assert _until(lambda: len(told()) == 2), told()
        assert told() == [("q", 3, "overdue", "4"), ("q", 3, "overdue", "5")]
        _append(folder / "q", _line("q", 4, 20_000, "end", None, 4))
        assert _until(lambda: len(told()) == 3)
        assert told()[2] == ("q", 4, "late", "4")
    finally:
        q.stop()


def test_a_smaller_clock_difference_moves_the_timers_up(spark, tmp_path):
    """The header arrives late, so the deadline seems far; the next record shows the instance's clock to be ahead by an hour."""
    folder = tmp_path / "in"
    folder.mkdir()
    _append(folder / "q", _line("q", 0, 0, "header") + _line("q", 1, 0, "begin", None, 1, 3_605_000))
    q = _watching(spark, folder, tmp_path / "cp", "moved", True, {"processingTime": "500 milliseconds"})
    try:
        assert _until(lambda: q.lastProgress is not None and q.lastProgress["batchId"] >= 0)
        time.sleep(2)
        assert spark.table("moved").count() == 0
        _append(folder / "q", _line("q", 2, 3_600_000, "begin", None, 2, 900_000_000))
        assert _until(lambda: spark.table("moved").count() == 1)
    finally:
        q.stop()
    assert [tuple(r) for r in spark.table("moved").collect()] == [("q", 2, "overdue", "1")]


def test_what_a_finished_run_left_open(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    _append(folder / "a", _line("a", 0, 0, "header") + _line("a", 1, 1, "begin", None, 1, 10) + _line("a", 2, 5, "end", None, 1) + _line("a", 3, 6, "terminal"))
    _append(folder / "b", _line("b", 0, 0, "header") + _line("b", 1, 1, "begin", None, 1, 10) + '{"instance": "b", "seq": 2')
    _append(folder / "c", _line("c", 0, 0, "header") + _line("c", 2, 1, "terminal"))
    _append(folder / "d", _line("d", 0, 0, "header") + "no json\n")
    q = _watching(spark, folder, tmp_path / "cp", "finished", False, {"availableNow": True})
    q.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("finished").collect())[:2] == [("a", 2, "done", "1"), ("a", 3, "ended", None)]
    left = sorted(tuple(r) for r in journal.unended(spark, str(tmp_path / "cp")).collect())
    assert left == [("b", 2, "no end"), ("c", 1, "gap in sequence"), ("d", 1, "no record: no json")]


def test_only_progress_restarts_the_wait(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    _append(folder / "a", "test 1\nnoise\n")
    lines = tail.tail(spark, str(folder))
    out = journal.paced(lines, "file", "line", F.col("line").startswith("test"), 2500)
    q = out.writeStream.format("memory").queryName("paced").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
    try:
        end = time.time() + 5
        while time.time() < end:
            _append(folder / "a", "noise\n")
            time.sleep(0.5)
        assert _until(lambda: spark.table("paced").count() == 1)
        _append(folder / "a", "test 2\n")
        assert _until(lambda: spark.table("paced").count() == 2)
    finally:
        q.stop()
    assert sorted(tuple(r)[1:] for r in spark.table("paced").collect()) == [(1, "test 1"), (2, "test 2")]
