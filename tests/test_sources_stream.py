from pyspark.sql import functions as F

from tallyspan.operators import sequences
from tallyspan.sources import formats, sinks, trees
from tallyspan.streaming import journal


def of_text(spark, text):
    return sequences.lines(spark.createDataFrame([("r", text)], "key string, text string"), "key", "text")


def test_a_tree(spark, rows, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "target").mkdir()
    (tmp_path / "src/a.rs").write_text("fn a() {}\n")
    (tmp_path / "src/b.bin").write_bytes(b"\xff\x00")
    (tmp_path / "target/x.rs").write_text("")
    files = trees.listing(spark, str(tmp_path))
    assert rows(trees.texts(files)) == [("src/a.rs", "fn a() {}\n"), ("src/b.bin", None)]
    assert rows(files.select("path", trees.is_binary(F.col("content")))) == [("src/a.rs", False), ("src/b.bin", True)]
    assert rows(trees.kept(files, ["**/*.rs"]).select("path")) == [("src/a.rs",)]
    assert rows(trees.guarded(files, 1, "files")) == [(2, "more than 1 files")]
    assert len(trees.tree_digest(files).first()[0]) == 64


def test_coverage(spark, rows):
    text = "SF:a.rs\nDA:1,0\nDA:2,0\nend_of_record\nSF:a.rs\nDA:1,7\nend_of_record\nSF:b.rs\nLF:100\nLH:80\nend_of_record\n"
    assert rows(formats.missed_lines(*formats.coverage(of_text(spark, text), "key"))) == [("a.rs", 1), ("b.rs", 20)]


def test_listings(spark, rows):
    assert rows(formats.blocks(of_text(spark, "pkg one:\n  a\n  b\n\n  c\n"), "key", r"^pkg (\w+):")) == [("r", "one", "a"), ("r", "one", "b")]
    good = formats.versioned_names(of_text(spark, "a v1.0\nb v2.0 (x)\n"), "key")
    assert rows(good) == [("r", "a", "1.0", False), ("r", "b", "2.0", False)]
    assert all(r[3] for r in rows(formats.versioned_names(of_text(spark, "a v1.0\n???\n"), "key")))
    noted = formats.diagnostics(of_text(spark, "warning: odd\n  --> a.rs:3\nother\n"), "key")
    assert rows(noted) == [("r", "odd", "a.rs", 3)]


def test_added_lines_are_numbered_from_the_hunk(spark, rows):
    log = "commit abcdef1\n+++ b/x.txt\n@@ -1,2 +5,3 @@\n same\n+one\n-gone\n+two\n+++ b/y.txt\n@@ -0,0 +1 @@\n+only\n"
    found = rows(formats.added_lines(of_text(spark, log), "key"))
    assert found == [("r", "abcdef1", "x.txt", 6, "one"), ("r", "abcdef1", "x.txt", 7, "two"), ("r", "abcdef1", "y.txt", 1, "only")]


def test_json_toml_yaml(spark, rows):
    held = formats.json_lines(of_text(spark, '{"a": 1}\n\nnope\n'), "key", "a int")
    assert rows(held.select("line", "value.a", "error")) == [(1, 1, None), (3, None, "line 3")]
    df = spark.createDataFrame([("t", '[a]\nb = "x"\nc = [1, true]\n'), ("u", "a = = 1")], "k string, t string")
    found = rows(formats.leaves(df, "k", "t", "toml"))
    assert found[:3] == [("t", "a.b", "x", None), ("t", "a.c[0]", "1", None), ("t", "a.c[1]", "true", None)] and found[3][3]
    text = "jobs:\n  build:\n    steps:\n      - uses: a/b@v1\n        name: 'x y'\n      - run: ls # list\n"
    got = rows(formats.leaves(spark.createDataFrame([("y", text)], "k string, t string"), "k", "t", "yaml"))
    assert got == [("y", "jobs.build.steps[0].name", "x y", None), ("y", "jobs.build.steps[0].uses", "a/b@v1", None), ("y", "jobs.build.steps[1].run", "ls", None)]


def test_sinks(spark, rows, tmp_path):
    path = f"file://{tmp_path}/out"
    for n in (1, 2):
        sinks.replace_table(spark.range(n).coalesce(1), path)
    assert sinks.read_table(spark, path).count() == 2
    found = spark.createDataFrame([("g", "f", i, f"m{i:02}") for i in range(12)], "gate string, file string, line int, message string")
    assert sorted(r[3] for r in rows(sinks.annotations(found)))[:1] == ["and 2 more"]


EVENTS = [
    ("a", 0, 0, "header", None, None, None), ("a", 1, 5, "begin", None, 1, 10), ("a", 2, 9, "end", None, 1, None), ("a", 3, 10, "begin", None, 2, 10), ("a", 4, 50, "begin", None, 3, 10),
    ("a", 5, 51, "end", None, 2, None), ("a", 6, 52, "end", None, 3, None), ("a", 7, 60, "terminal", None, None, None),
    ("b", 0, 0, "header", None, None, None), ("b", 2, 1, "begin", None, 1, 5), ("b", 3, 1, "terminal", None, None, None),
]
WANT = [("a", 2, "done", "1"), ("a", 4, "overdue", "2"), ("a", 5, "late", "2"), ("a", 6, "done", "3"), ("a", 7, "ended", None), ("b", 2, "error", "gap in sequence")]


def test_the_journal_as_a_stream(spark, tmp_path):
    spark.createDataFrame(EVENTS, journal.SCHEMA).coalesce(1).write.json(f"{tmp_path}/in")
    out = journal.watch(spark.readStream.schema(journal.SCHEMA).json(f"{tmp_path}/in"))
    q = out.writeStream.format("memory").queryName("watched").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((tuple(r) for r in spark.table("watched").collect()), key=repr)
    assert got == sorted(WANT, key=repr)


def test_the_journal_in_batch(spark, rows):
    df = spark.createDataFrame([(i, *e) for i, e in enumerate(EVENTS[:-1])], "arrived int, " + journal.SCHEMA)
    assert rows(journal.sequence_errors(df)) == [("b", 2, "gap in sequence")]
    assert rows(journal.sequence_errors(df.where("instance = 'a' and seq < 7"))) == [("a", 6, "no end")]
