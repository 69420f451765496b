import pytest
from pyspark.sql import functions as F

from tallyspan.functions import text as T
from tallyspan.operators import rules, sequences


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column).first()[0]


def blocks(spark, rows, text):
    df = spark.createDataFrame([("f", text)], "file string, text string")
    return [r[1:] for r in rows(sequences.comment_blocks(sequences.lines(df, "file", "text"), "file"))]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("let x = 1;\n// why one\n// and not two\nuse(x);\n// end\n", []),
        ("head();\n// first reason\n// second reason\n// third reason\n// fourth reason\ntail();\n", [(2, 4)]),
        ("// p\n// q\n// r\n// s\n\nmid();\n  // indented\n  // as well\n  // and so\n", [(1, 4), (7, 3)]),
        ("open();\n/// doc one\n/// doc two\n/// doc three", [(2, 3)]),
        ("//! top\n//! top two\n// plain\n// plain two\n/// doc\n", []),
    ],
)
def test_comment_blocks(spark, rows, text, want):
    assert blocks(spark, rows, text) == want


def test_lines_of_both_splitters(spark, rows):
    df = spark.createDataFrame([(1, "a\r\nb\n"), (2, ""), (3, None)], "k int, text string")
    assert rows(sequences.lines(df, "k", "text")) == [(1, 1, "a"), (1, 2, "b")]
    assert sequences.lines(df, "k", "text", scan=False).count() == 4


def test_ranges_and_unions(spark, rows):
    numbers = spark.createDataFrame([("a", n) for n in (9, 3, 4, 5, 5)] + [("b", 1)], "k string, n int")
    assert rows(sequences.ranges(numbers, "k", "n")) == [("a", "3-5, 9"), ("b", "1")]
    spans = spark.createDataFrame([("a", 0, 10), ("a", 5, 12), ("a", 20, 21), ("a", 3, 3)], "k string, s int, e int")
    assert rows(sequences.span_union(spans, "k", "s", "e")) == [("a", 13)]


def test_first_difference(spark):
    df = spark.createDataFrame([([1, 2], [1, 3]), ([1], [1, 2]), ([1], [1]), ([], [])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(sequences.first_difference(F.col("a"), F.col("b"))).collect()] == [1, 1, None, None]


@pytest.mark.parametrize(
    ("glob", "path", "want"),
    [("src/**", "src/a/b.rs", True), ("src/*.rs", "src/a/b.rs", False), ("**/b.rs", "b.rs", True), ("**/b.rs", "x/y/b.rs", True), ("a/?.rs", "a/b.rs", True), ("a/?.rs", "a/bb.rs", False), ("a.b", "axb", False)],
)
def test_globs(spark, glob, path, want):
    assert one(spark, T.in_scope(F.col("p"), [glob]), p=path) is want


@pytest.mark.parametrize(("text", "want"), [("a Todo here", True), ("todos", False), ("x.todo", False), ("todo-list", False), ("(todo)", True)])
def test_whole_words(spark, text, want):
    assert one(spark, T.whole_word(F.col("t"), "TODO"), t=text) is want


FLAG = "\U0001f3f4\U000e0067\U000e0062\U000e007f"


@pytest.mark.parametrize(("text", "want"), [("plain", None), ("a\U000e0041b", "tag"), (f"flag {FLAG}", None), ("a‮b", "bidi"), ("a️︎b", "selector"), ("a️️b", None)])
def test_hidden_characters(spark, text, want):
    assert one(spark, T.hidden(F.col("t")), t=text) == want


def test_scalar_functions(spark):
    c = F.col("t")
    assert one(spark, T.snake_case(c), t="HttpClientURLTool") == "http_client_url_tool"
    assert one(spark, T.words_of(c), t="getUsers of the class") == ["get", "user", "of", "the", "class"]
    assert one(spark, T.folded_path(c), t="a/./b/../c") == "a/c"
    assert one(spark, T.folded_path(c), t="../a") is None
    assert one(spark, T.anchor_end(c), t="src/a.rs:3-9,12") == 12
    assert one(spark, T.placeholders(c), t="{a} {{b}} {c:>3} {}") == ["a", "c", ""]
    assert one(spark, T.blank_quotes(c), t=r'a "b \" c" d') == "a   d"
    assert one(spark, T.strip_colour(c), t="\x1b[31mred\x1b[0m") == "red"
    assert one(spark, T.version(c) > T.version(F.lit("1.9.0")), t="1.10.0") is True
    assert one(spark, T.ago(F.lit(125)), t="") == "2 minutes ago"


def test_echoes(spark, rows):
    text = "// adds the users\nadd_users(users); // adds\n// why: see above\nadd();\n"
    df = sequences.lines(spark.createDataFrame([("f", text)], "file string, text string"), "file", "text")
    comment = F.when(F.startswith(F.ltrim("text"), F.lit("//")), F.substr(F.ltrim("text"), F.lit(3)))
    assert rows(rules.echoes(df, "file", comment)) == [("f", 1)]


def test_messages(spark, rows):
    df = spark.createDataFrame([(1, "Good\n\nbody"), (2, "Ends.\nno blank"), (3, "x" * 73), (4, " \n"), (5, None)], "k int, t string")
    assert rows(rules.message_findings(df, ["k"], "t")) == [(2, "full stop"), (2, "no blank line"), (3, "long subject"), (4, "empty"), (5, "empty")]


def test_stale_paths(spark, rows):
    cited = spark.createDataFrame([("src/a.rs",), ("a.rs",), ("x/a.rs",), ("b.rs",)], "cite string")
    present = spark.createDataFrame([("src/a.rs",)], "path string")
    assert rows(rules.missing_paths(cited, present)) == [("b.rs",), ("x/a.rs",)]


def test_waivers(spark, rows):
    df = spark.createDataFrame([("f", 1, "// allow: because of old data"), ("f", 2, "bad()"), ("f", 3, "bad()")], "k string, line int, text string")
    assert [r[3] for r in rows(rules.waived(df, "k", "allow"))] == [True, True, False]


def test_first_places(spark, rows):
    df = spark.createDataFrame([("f", i) for i in range(1, 31)], "k string, line int")
    (found,) = rows(rules.first_places(df, ["k"], "line", 20))
    assert found == ("f", 1, list(range(2, 22)), 30)
