import pytest
from pyspark.sql import functions as F

from tallyspan.operators import measures as M


def test_series_and_details(spark, rows):
    df = spark.createDataFrame([("a", 1, 16, "x"), ("a", 2, 20, "y"), ("a", 3, 20, "z"), ("b", 1, 3, "w")], "file string, line int, score int, what string")
    assert rows(M.series(M.over(df, "score", 15), "m", F.col("file"))) == [("m", "a", 3)]
    assert rows(M.series(M.over(df, "score", 15, True), "m", F.col("file"), F.col("score"), "max")) == [("m", "a", 5)]
    assert rows(M.worst_detail(df, ["file"], "score", "line", "what")) == [("a", 20, "y"), ("b", 3, "w")]
    assert rows(M.last_wins(df, ["file"], "line", "score")) == [("a", 20), ("b", 3)]
    names = spark.createDataFrame([("a",), ("c",)], "key string")
    assert rows(M.census(spark.createDataFrame([("a", 2)], "key string, value bigint"), names)) == [("a", 2), ("c", 0)]


def test_excuses_meet_findings_one_by_one(spark, rows):
    found = spark.createDataFrame([("f", 1), ("f", 2), ("g", 1)], "k string, line int")
    excused = spark.createDataFrame([("f",), ("h",)], "k string")
    left, unused = M.kth_excused(found, excused, ["k"], "line")
    assert rows(left) == [("f", 2), ("g", 1)] and rows(unused) == [("h", 1)]


@pytest.mark.parametrize(("uses", "want"), [("a/b@v1", True), ("a/b@" + "0" * 40, False), ("img@sha256:" + "a" * 64, False), ("./local", False), ("a/b", True)])
def test_movable_references(spark, uses, want):
    assert spark.range(1).select(M.movable_reference(F.lit(uses))).first()[0] is want


def test_dependencies_and_toolchains(spark):
    ask = lambda c: spark.range(1).select(c).first()[0]
    assert ask(M.unpinned_dependency(F.lit("*"), F.lit(None).cast("string"))) and not ask(M.unpinned_dependency(F.lit("1"), F.lit(None).cast("string")))
    assert ask(M.unpinned_dependency(F.lit("1"), F.lit("git+https://x?branch=main"))) and not ask(M.unpinned_dependency(F.lit("*"), F.lit("git+https://x?rev=" + "a" * 40)))
    assert ask(M.loose_toolchain(F.lit("stable"))) and not ask(M.loose_toolchain(F.lit("1.80.0"))) and not ask(M.loose_toolchain(F.lit("nightly-2024-01-02")))


def test_relations(spark, rows):
    packages = spark.createDataFrame([("1", "a", ["lib", "proc-macro"]), ("2", "b", ["custom-build"])], "id string, name string, targets array<string>")
    assert rows(M.build_time_code(packages, spark.createDataFrame([("2",)], "id string"))) == [("a", "proc-macro")]
    assert rows(M.oldest_promise(spark.createDataFrame([("1.10",), ("1.9",)], "version string"))) == [("1.9",)]
    a, b = (spark.createDataFrame(x, "k string, v bigint") for x in ([("p", 1), ("q", 5)], [("p", 4), ("q", 2), ("r", 1)]))
    assert rows(M.grown_most(a, b, "k", "v")) == [("p", 3), ("r", 1)]
    assert rows(M.duplicate_builds(spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "name string, version string"))) == [("a", 1)]
    calls = spark.createDataFrame([("f", 1, "open"), ("f", 2, "lock"), ("g", 1, "lock"), ("g", 2, "open")], "function string, place int, name string")
    rule = spark.createDataFrame([("open", "lock", True)], "name string, needs string, earlier boolean")
    assert rows(M.unpaired_calls(calls, rule)) == [("f", 1, "open", "lock")]
    uses = spark.createDataFrame([("db/a.rs", "sql"), ("ui/a.rs", "sql"), ("ui/a.rs", "css")], "path string, name string")
    assert rows(M.past_seam(uses, spark.createDataFrame([("sql", "db")], "name string, directory string"))) == [("ui/a.rs", "sql")]
    assert rows(M.pins(a.select(F.col("k").alias("name")), b.where("k = 'q'").select(F.col("k").alias("name")))) == [("p", 1), ("q", 0)]
    leaks = spark.createDataFrame([("r", "p", "abcdef123"), ("r", "q", "abcdef123")], "rule string, path string, commit string")
    known = spark.createDataFrame([("r", "p", "abcdef1", "old"), ("r", "q", "abc", "short")], "rule string, path string, commit string, reason string")
    assert rows(M.accepted_leaks(leaks, known)) == [("r", "q", "abcdef123")]
