from pyspark.sql import functions as F

from tallyspan.operators import graph as G
from tallyspan.operators import joins as J
from tallyspan.operators import records as D
from tallyspan.operators import similar as S
from tallyspan.operators.strong import Condensed


def test_pairing(spark, rows):
    left = spark.createDataFrame([("f", 3.0, 1), ("f", 9.0, 2), ("g", 1.0, 3)], "k string, s double, t int")
    right = spark.createDataFrame([("f", 4.0, 1), ("f", 8.0, 2), ("g", 1.005, 3), ("g", 5.0, 4)], "k string, s double, t int")
    assert rows(J.zip_within(left, right, ["k"], "s")) == [("f", 1, 3.0, 4.0), ("f", 2, 9.0, 8.0)]
    assert rows(J.worst_with_worst(left, right, ["k"], "s", "t")) == [("f", 1, 9.0, 8.0), ("f", 2, 3.0, 4.0), ("g", 1, 1.0, 5.0), ("g", 2, None, 1.005)]
    assert rows(J.within(left, right, ["k"], "s", 0.01)) == [("g", 1.0, 1.005)]


def test_owners_and_spans(spark, rows):
    paths = spark.createDataFrame([("a/b/c.rs",), ("a/x.rs",), ("y.rs",)], "path string")
    homes = spark.createDataFrame([("a",), ("a/b",)], "home string")
    assert rows(J.deepest_owner(paths, homes)) == [("a/b/c.rs", "a/b"), ("a/x.rs", "a"), ("y.rs", None)]
    points = spark.createDataFrame([("f", n) for n in (1, 5, 300, 900)], "k string, line int")
    spans = spark.createDataFrame([("f", 1, 400, "outer"), ("f", 4, 6, "inner")], "k string, first int, last int, name string")
    assert rows(J.enclosing(points, spans, "k", "line", "name")) == [("f", 1, "outer"), ("f", 300, "outer"), ("f", 5, "inner"), ("f", 900, None)]
    assert rows(J.outside(points, spans.drop("name"), "k", "line")) == [("f", 900)]


def test_a_matrix_of_another_width_is_refused(spark, rows):
    columns = spark.createDataFrame([("t", 0, "m0"), ("t", 1, "m1"), ("u", 0, "m0")], "target string, place int, mutation string")
    matrix = spark.createDataFrame([("t", "one", "D."), ("u", "one", "DD")], "target string, test string, marks string")
    found = J.marks_by_place(matrix, columns, "target", "marks", "place").select("target", "mutation", "mark", "refused")
    assert rows(found) == [("t", "m0", "D", False), ("t", "m1", ".", False), ("u", "m0", None, True)]


def test_overlays_and_closest(spark, rows):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3)], "k string, v int")
    assert rows(J.overlay(old, new, ["k"])) == [("a", 1), ("b", 3)]
    assert rows(J.changed_values(old, new, "k", "v")) == [("a", 1, None), ("b", 2, 3)]
    known = spark.createDataFrame([("baseline",), ("survey",), ("gates",)], "name string")
    asked = spark.createDataFrame([("basline",), ("gate",), ("zzz",)], "ask string")
    assert rows(J.closest(asked, known, "ask", "name")) == [("basline", "baseline", 1), ("gate", "gates", 1)]


def test_reach_route_components(spark, rows):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("d", "e")], "src string, dst string")
    root = spark.createDataFrame([("a",)], "node string")
    assert rows(G.reachable(edges, root)) == [("a", 0), ("b", 1), ("c", 1)]
    assert rows(G.route(edges, spark.createDataFrame([("b",)], "node string"), root)) == [("b", "a", ["b", "c", "a"])]
    assert rows(G.components(edges, "src", "dst")) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")]
    assert ("a", "c") in rows(Condensed(edges).other_ways())


def test_dominators_of_a_diamond(spark, rows):
    nodes = spark.createDataFrame([("g", n, 1) for n in "abcde"], "graph string, node string, weight int")
    edges = spark.createDataFrame([("g", *e) for e in (("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"))], "graph string, src string, dst string")
    found = G.dominators(nodes, edges)
    assert rows(found) == [("g", "a", None, 5), ("g", "b", "a", 1), ("g", "c", "a", 1), ("g", "d", "a", 2), ("g", "e", "d", 1)]
    assert rows(G.largest_parts(nodes, edges, 2)) == [("g", "d", 2, 2)]  # moving all would leave nothing


def test_families(spark, rows):
    bodies = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "a b c d e f g x"), (4, "q r s t"), (5, None)]
    df = spark.createDataFrame(bodies, "k int, t string")
    assert rows(S.exact_families(df, "k", F.col("t"))) == [(1, 1, 2), (2, 1, 2)]
    assert rows(S.near_families(df, "k", F.col("t"), F.split("t", " "))) == [(1, 1, 3), (2, 1, 3), (3, 1, 3)]
    one, other = F.array(*map(F.lit, "xyx")), F.array(*map(F.lit, "aba"))
    assert df.select(S.canonical(one) == S.canonical(other)).first()[0] is True


def test_the_settled_repeats_share_no_line(spark, rows):
    repeats = spark.createDataFrame([("f", 1, 5, 2, 9), ("f", 4, 4, 2, 6), ("f", 20, 3, 2, 7)], "k string, first int, lines int, sites int, saves int")
    assert [r[1] for r in rows(S.settle(repeats, "k"))] == [1, 20]


def test_a_timeout_never_equals_a_timeout(spark, rows):
    schema = "scenario string, step int, out string, timed_out boolean"
    left = spark.createDataFrame([("s", 0, "took 12 ms", False), ("t", 0, "x", True), ("u", 0, "a", False), ("v", 0, "a", False)], schema)
    right = spark.createDataFrame([("s", 0, "took 7 ms", False), ("t", 0, "x", True), ("u", 0, "b", False)], schema)
    allow = spark.createDataFrame([("u", "out")], "scenario string, field string")
    found = D.differential(left, right, ["out"], [{"kind": "digits", "token": "N"}], allow)
    assert rows(found) == [("s", "equal", 0), ("t", "error", 0), ("u", "allowed", 1), ("v", "error", 0)]
    assert left.select(D.memo_key(F.col("out"), F.lit(None))).first()[0] is None
