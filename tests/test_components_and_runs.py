"""Components over long chains, and repeated runs against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspan.operators import graph, similar


def _plain_components(links):
    above = {}

    def root(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            x, y = root(a), root(b)
            above[max(x, y)] = min(x, y)
    return sorted((x, root(x)) for x in above)


def test_a_chain_of_two_thousand_nodes(spark, rows):
    names = list(range(2000))
    random.Random(1).shuffle(names)
    links = list(zip(names, names[1:]))
    random.Random(2).shuffle(links)
    told = []
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(16)
    assert rows(graph.components(df, told=told)) == sorted(_plain_components(links), key=repr)
    assert told[0] <= 15


@pytest.mark.parametrize("seed", range(3))
def test_random_components(spark, rows, seed):
    rng = random.Random(seed)
    links = [(f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(90)] + [("hub", f"n{i}") for i in range(0, 120, 3)] + [("me", "me"), ("x", None), (None, None), ("hub", "n0")]
    df = spark.createDataFrame(links, "a string, b string").repartition(5)
    assert rows(graph.components(df)) == sorted(_plain_components(links), key=repr)


def test_no_links(spark):
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
    assert [tuple(r) for r in graph.components(spark.createDataFrame([(1, 1), (2, None)], "a bigint, b bigint")).collect()] == [(1, 1)]


def plain_runs(texts, least):
    """Every start with every other: the longest common run, its places, and the lines before them."""
    starts = [(k, p) for k, ls in texts.items() for p in range(len(ls))]

    def common(a, b):
        n = 0
        while a[1] + n < len(texts[a[0]]) and b[1] + n < len(texts[b[0]]) and texts[a[0]][a[1] + n] == texts[b[0]][b[1] + n]:
            n += 1
        return n

    out = []
    for s in starts:
        n = max((common(s, t) for t in starts if t != s), default=0)
        if n < least:
            continue
        sites = [s, *[t for t in starts if t != s and common(s, t) >= n]]
        left = lambda t: texts[t[0]][t[1] - 1] if t[1] else None
        if left(s) is None or all(left(t) != left(s) for t in sites[1:]):
            out.append((s[0], s[1] + 1, n, len(sites)))
    return sorted(out, key=repr)


def _lines(spark, texts):
    return spark.createDataFrame([(k, p + 1, x) for k, ls in texts.items() for p, x in enumerate(ls)], "k bigint, i int, x string")


@pytest.mark.parametrize(("seed", "least"), [(0, 3), (2, 2), (4, 1)])
def test_runs_against_brute_force(spark, rows, seed, least):
    rng = random.Random(seed)
    base = [rng.choice("abcdefgh") for _ in range(40)]
    texts = {}
    for k in range(14):
        ls = [rng.choice("abcdefghij") for _ in range(rng.randrange(12))]
        for _ in range(rng.randrange(4)):
            a = rng.randrange(30)
            ls += base[a : a + rng.randrange(2, 25)] + [rng.choice("xyz")]
        texts[k] = ls
    texts[20] = texts[21] = base  # copies of whole texts
    texts[22] = ["same"] * 30  # a hot line, and runs within one text
    found = similar.repeated_runs(_lines(spark, texts), "k", "i", F.col("x"), least)
    assert rows(found) == plain_runs(texts, least)


def test_runs_of_odd_rows(spark, rows):
    assert similar.repeated_runs(spark.createDataFrame([], "k bigint, i int, x string"), "k", "i", F.col("x")).collect() == []
    data = [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "a"), (2, 2, "b"), (2, 4, "c"), (3, 7, "a"), (3, 8, "b"), (3, 9, "c"), (None, 1, "a"), (None, 2, "b"), (None, 3, "c"), (4, None, "a"), (5, 1, None)]
    found = similar.repeated_runs(spark.createDataFrame(data, "k bigint, i int, x string"), "k", "i", F.col("x"))
    assert rows(found) == [(1, 1, 3, 2), (3, 7, 3, 2)]  # a missing number ends a run
