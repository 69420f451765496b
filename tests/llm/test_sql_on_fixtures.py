"""The SQL of the queries says the same as the operators on small tables that hold what the large ones don't."""

import random

import duckdb
import pytest

from tallyspan.llm import byte_repeats, near_copies, url_filter


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(7)
    words = ["ä" + str(i) for i in range(60)] + ["Wort", "word", "x"]
    body = [rng.choice(words) for _ in range(400)]
    texts = [None, "", " \t", "one two", "One TWO", " ".join(body), " ".join(body[:390] + ["other"]), " ".join(body[100:300]), " ".join(rng.choice(words) for _ in range(300)), "ab" * 400, "é" * 220 + "!"]
    rows = [(i, t, "de", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{where}/documents.parquet")
    pages = [
        (1, "http://A.example.com/en/7", '<a href="http://friend.test/x">f</a> <a href="//Friend.test/y">g</a>'),
        (2, "http://bad.com/en/1", "<p>nothing</p>"),
        (3, "http://feeder.test/a?b", "<a href=http://bad.com/en/1> <a href='http://elsewhere.test#q'>"),
        (4, "http://friend.test/z", '<a href="http://feeder.test/">'),
        (5, "http://elsewhere.test", None),
        (6, None, '<a href="http://bad.com/">'),
        (7, "no address", ""),
        (8, "http://far.test/q", '<a href="http://feeder.test/a">'),
        (9, "http://x.example.net/de/8/1", "<a href='http://far.test/'>"),
    ]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{where}/pages.parquet")
    return where


@pytest.mark.parametrize(("operator", "name"), [(byte_repeats, "documents"), (near_copies, "documents"), (url_filter, "pages")])
def test_sql_says_the_same(spark, rows, folder, operator, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    got = operator.query(spark, folder)
    told = con.execute(operator.SQL)
    order = [c[0] for c in told.description]
    want = sorted(told.fetchall(), key=lambda r: r[0])
    assert sorted((tuple(r) for r in got.select(*order).collect()), key=lambda r: r[0]) == want
    if operator is url_filter:  # links alone decide the verdict of the page that feeds a blocked host
        assert {r[0]: r[4] for r in want}[3] == "block"
        assert {r[0]: r[4] for r in want}[4] == "allow"
