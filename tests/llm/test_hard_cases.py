"""Inputs that broke earlier versions: structured words, long chains of hosts, long items, equal captures, odd rows in the pipeline."""

import numpy as np
import pytest

from tallyspan.llm import _arrays as A
from tallyspan.llm import _base, byte_repeats, contamination, languages, near_copies, url_filter, warc, word_repeats


def _thue_morse(n, swap=False):
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


@pytest.mark.parametrize("n", [16, 100, 1024, 2048, 4096])
def test_structured_strings_have_digests_of_their_own(n):
    both = np.frombuffer((_thue_morse(n) + _thue_morse(n, True)).encode(), np.uint8)
    a, b = A.byte_spans(both, np.array([0, n]), np.array([n, 2 * n]))
    assert a != b
    values = A.mix(both.astype(np.uint64))
    a, b = A.Digests(values).spans(np.array([0, n]), np.array([n, 2 * n]))
    assert a != b


def test_digests_tell_contents_and_lengths_apart():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    starts = rng.integers(0, 2900, 4000)
    ends = starts + rng.integers(0, 100, 4000)
    spans = A.byte_spans(data, starts, ends)
    of_values = A.Digests(A.mix(data.astype(np.uint64))).spans(starts, ends)
    texts = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    for digests in (spans, of_values):
        by = {}
        for t, d in zip(texts, digests.tolist(), strict=True):
            assert by.setdefault(t, d) == d
        assert len(set(by.values())) == len(by)
    for k in (1, 5, 8, 9, 16, 24, 33):
        grams = A.byte_grams(data, k)
        assert len(grams) == len(data) - k + 1
        assert (grams == A.byte_grams(data.copy(), k)).all()
        assert len(set(grams.tolist())) == len({data[i : i + k].tobytes() for i in range(len(grams))})


@pytest.mark.parametrize("n", [1024, 4096])
def test_long_structured_words_are_no_repeats_and_no_copies(spark, docs, n):
    same = " ".join(f"w{i}" for i in range(49))
    table = docs([(1, f"{same} {_thue_morse(n)}"), (2, f"{same} {_thue_morse(n, True)}")])
    assert {r["n_removed"] for r in word_repeats.remove_repeats(table).collect()} == {0}
    alone = docs([(1, _thue_morse(n)), (2, _thue_morse(n, True)), (3, _thue_morse(n))])
    assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(alone).collect()} == {1: 1, 2: 2, 3: 1}


def test_a_long_chain_of_hosts_is_judged_whole(spark):
    """A chain of 18 hosts that ends in a blocked one: nothing trusts them, so all are blocked down to the floor's reach."""
    rows = [(i, f"http://h{i}.example/", f'<a href="http://h{i + 1}.example/">x</a>') for i in range(18)]
    rows += [(18, "http://h18.example/bad/", None), (101, "http://apart.example/", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, rules=(("block", "h18.example", "/bad/"),), damping=0.4).collect()}
    assert [i for i in range(19) if found[i] != "block"] == [] and found[101] == "allow"


def test_hosts_with_less_than_the_floor_count_as_unreached(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "src string, dst string, w double")
    seeds = spark.createDataFrame([("a", 1.0)], "host string, seed double")
    whole = {r["host"]: r["score"] for r in url_filter.propagate(edges, seeds, damping=0.5).collect()}
    assert sum(whole.values()) == pytest.approx(1.0) and set(whole) == {"a", "b", "c"}
    assert set(r["host"] for r in url_filter.propagate(edges, seeds, damping=0.5, floor=whole["c"] * 1.3).collect()) == {"a", "b"}
    assert url_filter.rounds_for(0.85, 1e-9) > 140


def test_a_long_item_costs_a_window_at_a_time(spark, docs):
    rng = np.random.default_rng(1)
    words = [f"t{x}" for x in rng.integers(0, 4000, 20_000)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    text = " ".join(["x", *words[5000:5010], "y", *words[9000:9009], "z"])
    found = contamination.judge(docs([(1, text), (2, " ".join(words))]), items).collect()
    hits = {r["doc_id"]: list(r["hits"]) for r in found}
    assert hits[1] == list(range(1, 11)) and hits[2] == list(range(20_000))


def test_equal_captures_stay_apart(spark, tmp_path):
    rows = [(7, "http://a/", "same")] * 200 + [(9, "http://b/", "same"), (None, None, "same")]
    path = str(tmp_path / "warc")
    warc.write_captures(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3), path)
    captures = warc.assemble(warc.read_records(spark, path)).collect()
    assert len(captures) == 202 == len({r["capture_id"] for r in captures})
    assert {(len(r["requests"]), len(r["metadata"])) for r in captures} == {(1, 1)}


def test_equal_captures_are_found_by_their_revisits(spark, tmp_path):
    rows = [(7, "http://a/", "same")] * 5 + [(9, "http://b/", "same"), (3, "http://c/", "other")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = warc.query(spark, str(tmp_path)).collect()
    told = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in found)
    assert told == [(3, "response", None)] + [(7, "response", None)] * 5 + [(9, "revisit", 7)]


def test_sizes_of_joins_are_those_of_their_tables(spark, docs, tmp_path):
    docs([f"text {i} " * 50 for i in range(300)]).write.parquet(str(tmp_path / "d"))
    table = spark.read.parquet(str(tmp_path / "d"))
    alone = _base.input_bytes(table)
    both = table.join(table.withColumnRenamed("text", "other"), "doc_id")
    assert _base.input_bytes(both) == 2 * alone < 1 << 20


def test_each_task_counts_only_the_languages_it_saw(spark, docs, monkeypatch):
    monkeypatch.setattr(languages, "FAN", 2)
    table = docs([(i, "the house and the tree") for i in range(20)]).unionByName(docs([(100 + i, "das haus und der baum") for i in range(20)], lang="de")).repartition(7)
    model = languages.train(table)
    again = languages.train(table.coalesce(1))
    assert model.languages == again.languages == ["de", "en"] and np.allclose(model.log_p, again.log_p)
    found = {r["doc_id"]: r for r in languages.label(docs([(1, "the tree"), (2, "der baum")]), model).collect()}
    assert found[1]["lang_pred"] == "en" and [(s["first"], s["last"], s["lang"]) for s in found[2]["spans"]] == [(0, 1, "de")]


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _pipeline(spark, df, folder):
    import corpus_pipeline

    df.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id bigint, text string").write.parquet(str(folder / "benchmark.parquet"))
    return corpus_pipeline.run(spark, str(folder)).collect()


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert _pipeline(spark, spark.createDataFrame([], ODD), tmp_path) == []


def test_pipeline_of_odd_rows(spark, tmp_path):
    plain = "the quick brown fox jumps over the lazy dog near the old river bank today and tomorrow "
    rows = [(1, plain + "one", "en", "a", 90), (1, plain + "one", "en", "a", 90), (2, None, None, None, None), (3, "", "en", "a", 0), (None, plain * 2 + "and a null id here", "en", None, 5)]
    rows += [(None, "another text with no id at all but with enough words to stand by itself " * 2, None, "b", 5), (4, "123 456 !!", "en", "a", 9), (5, "x " + "one two three four five six seven eight nine ten eleven", "en", "b", 1)]
    df = spark.createDataFrame(rows, ODD).selectExpr("*", "1 as _doc", "'q' as score", "3 as copies", "4 as node", "5 as _own")
    found = _pipeline(spark, df, tmp_path)
    assert {r["doc_id"] for r in found} <= {1, None}  # no language, no text, or a benchmark's passage
