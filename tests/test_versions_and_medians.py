"""Texts at a revision, medians with a hot group, declared commands, and tables replaced by pointer."""

import random
import statistics

import pytest

from tallyspan.operators import declared, reports, versions
from tallyspan.sources import sinks


def test_texts_at_a_revision(spark, rows):
    held = [("a", 2, "two"), ("a", 5, None), ("a", 7, "seven"), ("a", 7, "later"), ("b", 4, "four"), (None, 1, "x"), ("c", None, "y")]
    asked = [("a", 1), ("a", 2), ("a", 3), ("a", 3), ("a", 5), ("a", 6), ("a", 99), ("b", 3), ("none", 8), (None, 2), ("a", None)]
    got = versions.text_at(spark.createDataFrame(held, "path string, revision int, text string"), spark.createDataFrame(asked, "path string, revision int"))
    want = [("a", 1, None, None), ("a", 2, 2, "two"), ("a", 3, 2, "two"), ("a", 3, 2, "two"), ("a", 5, 5, None), ("a", 6, 5, None), ("a", 99, 7, "seven"), ("b", 3, None, None), ("none", 8, None, None), (None, 2, None, None), ("a", None, None, None)]
    assert rows(got) == sorted(want, key=repr)


def test_random_revisions_against_a_scan(spark, rows):
    rng = random.Random(1)
    held = {(rng.choice("abc"), rng.randrange(60)): rng.choice([None, f"t{i}"]) for i in range(60)}
    asked = [(rng.choice("abcd"), rng.randrange(70)) for _ in range(200)]
    got = versions.text_at(spark.createDataFrame([(*k, t) for k, t in held.items()], "path string, revision int, text string").repartition(4), spark.createDataFrame(asked, "path string, revision int"))
    want = []
    for p, r in asked:
        v = max((x for q, x in held if q == p and x <= r), default=None)
        want.append((p, r, v, None if v is None else held[p, v]))
    assert rows(got) == sorted(want, key=repr)


def test_medians_are_exact(spark, monkeypatch):
    rng = random.Random(2)
    data = [(g, rng.choice([None, rng.randrange(20), rng.random() * 1e6])) for g in ("x", None, "hot") for _ in range(3000 if g == "hot" else rng.randrange(1, 400))]
    data += [(f"n{n}", float(v)) for n in range(1, 8) for v in range(n)] + [("same", 5.0)] * 100 + [("empty", None)]
    data = [(g, None if v is None else float(v)) for g, v in data]
    by = {}
    for g, v in data:
        if v is not None:
            by.setdefault(g, []).append(v)
    df = spark.createDataFrame(data, "g string, v double").repartition(6)
    want = {g: statistics.median(vs) for g, vs in by.items()}
    assert {r["g"]: r["median"] for r in reports.medians(df, "g", "v").collect()} == pytest.approx(want)
    monkeypatch.setattr(reports, "_ACCURACY", 1000)  # a coarse sketch with wider bounds gives the same
    monkeypatch.setattr(reports, "_AROUND", 0.05)
    assert {r["g"]: r["median"] for r in reports.medians(df, "g", "v").collect()} == pytest.approx(want)
    above = sorted((str(r["g"]), r["v"]) for r in reports.above_median(df, "g", "v").collect())
    assert above == sorted((str(g), v) for g, vs in by.items() for v in vs if v > want[g])


def test_what_commands_come_to(spark, rows):
    runs = [
        ("ok", 0, "", False, None, False), ("bad", 2, "", False, [3], False), ("stopped", None, None, False, None, False), ("blind", 3, "", False, [3], False), ("long", 0, "{}", True, None, True),
        ("counts", 0, '{"b": 2, "a": 0}', True, None, None), ("none", 0, "{}", True, None, False), ("words", 0, "no json", True, None, False), ("list", 0, "[1]", True, None, False),
        ("minus", 0, '{"a": -1}', True, None, False), ("half", 0, '{"a": 1.5}', True, None, False), ("many", 0, '{"a": 60000, "b": 40001}', True, None, False), ("just", 0, '{"a": 60000, "b": 40000}', True, None, False), ("fell", 1, '{"a": 1}', True, None, False),
    ]
    got = declared.judge_commands(spark.createDataFrame(runs, "name string, code int, said string, counts boolean, cannot_run array<int>, truncated boolean"))
    told = {}
    for r in got.collect():
        told.setdefault(r["name"], []).append((r["status"], r["key"], r["value"]))
    assert told == {
        "ok": [("passed", None, None)], "bad": [("failed", None, None)], "stopped": [("failed", None, None)], "blind": [("cannot run", None, None)], "long": [("cannot run", None, None)],
        "counts": [("counted", "a", 0), ("counted", "b", 2)], "words": [("refused", None, None)], "list": [("refused", None, None)], "minus": [("refused", None, None)], "half": [("refused", None, None)],
        "many": [("refused", None, None)], "just": [("counted", "a", 60000), ("counted", "b", 40000)], "fell": [("cannot run", None, None)],
    }


def test_a_table_is_replaced_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        sinks.read_table(spark, path)
    assert sinks.replace_table(spark.range(3), path) == 1
    old = sinks.read_table(spark, path)
    with monkeypatch.context() as m:
        m.setattr(sinks, "_point", lambda *a: (_ for _ in ()).throw(OSError("the second step fails")))
        with pytest.raises(OSError):
            sinks.replace_table(spark.range(5), path)
    assert sinks.read_table(spark, path).count() == 3
    assert sinks.replace_table(spark.range(7), path) == 2
    assert old.count() == 3 and sinks.read_table(spark, path).count() == 7
    (tmp_path / "table" / "version-000000000003").write_text("data-half")  # a writer that died in the second step
    assert sinks.read_table(spark, path).count() == 7 and sinks.table_version(spark, path)[0] == 2
    assert sinks.replace_table(spark.range(9), path) == 4
    assert sinks.read_table(spark, path).count() == 9
    assert sinks.forget_versions(spark, path, keep=1) == 3 and sinks.read_table(spark, path).count() == 9


def test_a_writer_that_came_second_is_told(spark, tmp_path):
    path = str(tmp_path / "table")
    sinks.replace_table(spark.range(1), path)
    seen, _ = sinks.table_version(spark, path)
    assert sinks.replace_table(spark.range(2), path, expected=seen) == 2
    with pytest.raises(sinks.Conflict):
        sinks.replace_table(spark.range(3), path, expected=seen)
    assert sinks.read_table(spark, path).count() == 2
