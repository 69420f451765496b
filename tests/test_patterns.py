"""A thousand rules at once against one regular expression each."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tallyspan.functions import text as T
from tallyspan.operators import patterns


def _lines(rng, n):
    piece = lambda: rng.choice(["abc", "de", "f-g", ".h", "i_j", "K", "é", "ab cd", "2", "x", " ", " ", "-", "."])
    return [(i, rng.choice(["src/a.rs", "src/b/c.rs", "tests/d.rs", None]), None if i % 17 == 0 else "".join(piece() for _ in range(rng.randrange(12)))) for i in range(n)]


def _naive(df, rules, path):
    out = set()
    for r in rules:
        hit = T.whole_word(F.col("text"), r["text"]) if r.get("word") else T.anywhere(F.col("text"), r["text"])
        if path:
            hit = hit & T.in_scope(F.coalesce("path", F.lit("\n")), r.get("in", []), r.get("except", []))
        out |= {(k, r["text"]) for (k,) in df.where(hit).select("k").collect()}
    return out


@pytest.mark.parametrize("path", [None, "path"])
def test_rules_against_one_expression_each(spark, path):
    rng = random.Random(3)
    df = spark.createDataFrame(_lines(rng, 400), "k int, path string, text string").cache()
    rules = [{"text": t, "word": w} for t in ("abc", "de", "ABc", "f-g", "h", ".h", "é", "ab cd", "cd", "2", "x", "k") for w in (True, False)]
    if path:
        rules = [r | rng.choice([{}, {"in": ["src/**"]}, {"except": ["src/*.rs"]}, {"in": ["**/*.rs"], "except": ["tests/**"]}]) for r in rules]
    found = {(r["k"], r["phrase"]) for r in patterns.phrases_in(df, "k", rules, path=path).collect()}
    assert found == _naive(df, rules, path)


def test_a_thousand_rules_cost_little_more_than_one(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 7))) for _ in range(1000)]
    texts = [(i, " ".join(rng.choice(words) if rng.random() < 0.1 else "".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(30))) for i in range(3000)]
    df = spark.createDataFrame(texts, "k int, text string").cache()
    assert df.count() == 3000
    rules = [{"text": w, "word": True} for w in dict.fromkeys(words)]
    patterns.phrases_in(df, "k", rules[:1]).collect()

    def took(some):
        began = time.time()
        found = {(r["k"], r["phrase"]) for r in patterns.phrases_in(df, "k", some).collect()}
        return found, time.time() - began

    one, all_of_them = took(rules[:1]), took(rules)
    assert all_of_them[1] < 10 * one[1] + 5
    listed = {r["text"] for r in rules}
    assert all_of_them[0] == {(i, w) for i, t in texts for w in set(t.split()) & listed}


def test_shapes_against_the_expression(spark):
    rng = random.Random(5)
    texts = [(i, None if i == 3 else "".join(rng.choice(["AKIA", "sk-", "ghp_", "A", "b", "9", " ", ".", "-", "AKIAAKIA"]) for _ in range(rng.randrange(15)))) for i in range(500)]
    df = spark.createDataFrame(texts, "k int, t string")
    shapes = [{"name": "one", "prefix": "AKIA", "tail": 3, "documented": ["bbb"]}, {"name": "two", "prefix": "sk-", "tail": 2}, {"name": "three", "prefix": "ghp_", "tail": 0}, {"name": "four", "prefix": "AKIA", "tail": 6}]
    found = sorted((r["k"], r["name"]) for r in patterns.shapes_in(df, "k", "t", shapes).collect())
    want = []
    for s in shapes:
        rows = df.where("t is not null").select("k", F.size(T.shape(F.col("t"), s["prefix"], s["tail"], s.get("documented", ()))).alias("n")).collect()
        want += [(r["k"], s["name"]) for r in rows for _ in range(r["n"])]
    assert found == sorted(want)


def test_no_rules_and_empty_ones(spark):
    df = spark.createDataFrame([(1, "x")], "k int, text string")
    assert patterns.phrases_in(df, "k", []).collect() == [] and patterns.shapes_in(df, "k", "text", []).collect() == []
    with pytest.raises(ValueError):
        patterns.phrases_in(df, "k", [{"text": ""}])
