import base64
import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspan.llm import languages, mixing, quality, toxicity, url_filter, warc


# Mixing


def test_the_mixture_follows_the_weights(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 10).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 > 0, "big").otherwise("small").alias("source"), F.lit(10).cast("bigint").alias("n_chars"))
    mixed = mixing.mix_sources(docs, {"big": 1.0, "small": 3.0}, epochs=1.0)
    share = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(share["small"] / 6000 - 0.75) < 0.04 and abs(share["big"] / 6000 - 0.25) < 0.03
    again = mixing.mix_sources(docs.repartition(7), {"big": 1.0, "small": 3.0})
    assert mixed.exceptAll(again).count() == 0 and again.exceptAll(mixed).count() == 0
    assert mixing.mix_sources(docs, {"big": 1.0, "small": 3.0}, seed=18).exceptAll(mixed).count() > 0


def test_poisson_by_inversion(spark):
    rate = 2.5
    table = spark.range(1).select(mixing.poisson_table(F.lit(rate), 40)).first()[0]
    p = [math.exp(-rate) * rate**k / math.factorial(k) for k in range(41)]
    assert np.allclose(table, np.cumsum(p))


def test_mixing_odd_rows(docs, clash):
    df = docs([(None, "some text"), (1, None), (2, ""), (3, "abc"), (3, "abc")], source=None)
    found = mixing.mix_sources(clash(df), {}, epochs=8.0).groupBy("doc_id").count().collect()
    counts = {r["doc_id"]: r["count"] for r in found}
    assert counts[3] % 2 == 0
    assert mixing.mix_sources(docs([]).limit(0), {}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(df, {}, max_rate=1000.0)


# WARC


def test_a_round_trip_keeps_every_byte(spark, clash, tmp_path):
    odd = ["plain", "a\r\n\r\nb", "ends\r\n", "ends\r\n\r\n", "\r\n\r\n", "", None, "é\u2028ß", "WARC/1.1\r\nContent-Length: 3\r\n\r\nx", "plain", "x" * 100_000]
    pages = [(i, f"http://h{i}.example/\r\npath", t) for i, t in enumerate(odd)] + [(None, None, "plain"), (1, "u", "a\r\n\r\nb")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    warc.write_captures(clash(df), f"file://{tmp_path}/w")
    records = warc.read_records(spark, f"file://{tmp_path}/w", with_payload=True)
    kinds = Counter(r["record_type"] for r in records.collect())
    assert kinds["request"] == kinds["metadata"] == len(pages) == kinds["response"] + kinds["revisit"]
    found = warc.assemble(records).collect()
    got = Counter()
    for r in found:
        page = r["metadata"][0]["fields"]["pageid"]
        got[page, r["answer"]["payload_bytes"], r["answer"]["payload_digest"]] += 1
        if r["answer"]["record_type"] == "response":
            assert base64.b32encode(hashlib.sha1(r["answer"]["payload"]).digest()).decode() == r["answer"]["payload_digest"]
    want = Counter(("" if i is None else str(i), len((t or "").encode()), base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()) for i, _, t in pages)
    assert got == want
    assert sum(r["answer"]["record_type"] == "revisit" for r in found) == 3  # 9 and the page without id repeat 0, 6 repeats 5


def test_foreign_archives(spark):
    block = b"HTTP/1.1 200 OK\r\n\r\nbody"
    raw = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nX: folded\r\n more\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    cut = raw + raw[:-20]
    rows = list(warc.records_of(iter(cut.split(b"\r\n\r\n")), True))
    assert [(r["record_id"], r["payload"]) for r in rows][0] == ("<a>", b"body")
    assert rows[-1]["payload_digest"] is None
    assert list(warc.records_of(iter([]))) == []


def test_links_may_point_either_way_or_by_way_of_a_request(spark):
    names = "record_id string, record_type string, target_uri string, date string, concurrent_to array<string>, refers_to string, content_type string, payload_bytes bigint, payload_digest string, fields map<string,string>, payload binary"
    row = lambda i, kind, to: (i, kind, None, None, to, None, None, 0, None, {}, None)
    records = spark.createDataFrame([row("r1", "response", ["q1"]), row("q1", "request", []), row("m1", "metadata", ["q2"]), row("q2", "request", ["r2"]), row("r2", "response", []), row("r3", "response", []), row("x", "request", ["gone"])], names)
    found = {r["capture_id"]: (len(r["requests"]), len(r["metadata"])) for r in warc.assemble(records).collect()}
    assert found == {"r1": (1, 0), "r2": (1, 1), "r3": (0, 0)}


# Languages


def test_mixed_text_is_labelled_by_spans(docs):
    r = random.Random(1)
    en, gr = ["the", "house", "with", "water", "thing"], ["και", "το", "σπίτι", "νερό"]
    de = ["über", "schule", "nicht", "zwischen", "kirche"]
    say = lambda ws, n: " ".join(r.choice(ws) for _ in range(n))
    train = docs([(i, say(en, 40)) for i in range(30)], "en").unionByName(docs([(100 + i, say(de, 40)) for i in range(30)], "de")).unionByName(docs([(200 + i, say(gr, 40)) for i in range(30)], "el"))
    model = languages.train(train)
    assert model.languages == ["de", "el", "en"]
    texts = [say(en, 30) + " " + say(de, 12) + " nicht", say(gr, 9), "12 34 !?", "", None, "the water über house the with", "日本語"]
    found = {r["doc_id"]: r for r in languages.label(docs(texts), model).collect()}
    assert [s["lang"] for s in found[0]["spans"]] == ["en", "de"] and found[0]["spans"][1]["first"] == 30
    assert (found[0]["lang_pred"], found[1]["lang_pred"], found[5]["lang_pred"]) == ("en", "el", "en")
    assert [(found[i]["lang_pred"], found[i]["score"]) for i in (2, 3, 4)] == [("und", 0.0)] * 3
    assert len(found[5]["spans"]) == 1 and 0 <= found[0]["score"] <= 1
    kept = languages.accepted(docs(texts, lang=None), model).collect()
    assert {r["doc_id"] for r in kept} >= {0, 1, 5} and not {2, 3, 4} & {r["doc_id"] for r in kept}
    assert {r["doc_id"]: r["lang"] for r in kept}[1] == "el"


def test_paths_against_brute_force():
    r = np.random.default_rng(3)
    lengths = [5, 0, 1, 7, 3]
    offsets = np.append(0, np.cumsum(lengths))
    scores = r.normal(size=(offsets[-1], 3)).astype(np.float32) * 4
    path = languages.best_paths(scores, offsets, 3.0)
    import itertools

    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        value = lambda p, a=a: sum(scores[a + i, x] for i, x in enumerate(p)) - 3.0 * sum(x != y for x, y in itertools.pairwise(p))
        if b > a:
            best = max(itertools.product(range(3), repeat=int(b - a)), key=value)
            assert abs(value(path[a:b]) - value(best)) < 1e-4


def test_without_labels_all_is_undetermined(docs, clash):
    model = languages.train(docs(["text"], lang=None))
    assert model.languages == []
    assert [tuple(r)[1:3] for r in languages.label(clash(docs(["some text", None])), model).collect()] == [("und", 0.0)] * 2
    assert languages.label(docs([]).limit(0), model).count() == 0


# URLs


def test_rules_and_parts_of_urls(spark, clash):
    urls = ["HTTP://A.Example.COM/en/7x?q", "http://x.com/en/1", "http://EXAMPLE.net/de/81", "http://b.net/de/1", "ftp://a.org", "no scheme", None, "x://h://k/p", "http://example.com:80/en/7", "http://com/en/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    found = {r["page_id"]: tuple(r)[1:5] for r in url_filter.judge_urls(clash(pages)).collect()}
    assert found[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert found[1] == ("x.com", "/en/1", "com/en/", "block")
    assert found[2] == ("example.net", "/de/81", "example.net/de/8", "block")
    assert found[3] == ("b.net", "/de/1", "net/de/", "allow")
    assert found[4] == ("a.org", "", None, "allow")
    assert found[5] == found[6] == ("", "", None, "allow")
    assert found[7][:2] == ("h:", "//k/p")
    assert found[8][2] is None and found[9][2] == "com/en/"
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_propagation_against_dense_iteration(spark):
    links = {"t": ["a", "b"], "a": ["b", "c"], "b": ["c"], "c": ["a", "bad"], "d": ["bad", "bad2"], "bad": ["d"], "e": ["bad"], "z": []}
    pages = [(i, f"http://{h}/allow" if h == "t" else f"http://{h}/x", "".join(f"<a HREF='http://{x}/p'>" for x in out) + '<a href="/self">') for i, (h, out) in enumerate(links.items())] + [(99, "http://bad/block", ""), (98, "http://bad2/block", "")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    found = {r["host"]: r for r in url_filter.judge_urls(df, [("allow", "t", "/allow"), ("block", "bad", "/block"), ("block", "bad2", "/block")]).collect()}

    def dense(edges, seeds):
        mass = sum(seeds.values())
        score = dict(seeds)
        for _ in range(200):
            nxt = Counter()
            for h, out in edges.items():
                for x in out:
                    nxt[x] += 0.85 * score.get(h, 0) / len(out)
            back = (mass - sum(nxt.values())) / mass  # what is not passed on returns to the seeds
            for h, s in seeds.items():
                nxt[h] += back * s
            score = nxt
        return score

    back = {}
    for h, out in links.items():
        for x in out:
            back.setdefault(x, []).append(h)
    trust, distrust = dense(links, {"t": 1.0}), dense(back, {"bad": 1.0, "bad2": 1.0})
    for h, r in found.items():
        assert abs(r["trust"] - trust.get(h, 0)) < 1e-4 and abs(r["distrust"] - distrust.get(h, 0)) < 1e-4
        if r["rule"] is None:
            assert r["verdict"] == ("block" if r["distrust"] > 0.5 * (r["trust"] + r["distrust"]) else "allow")
    assert found["e"]["verdict"] == found["d"]["verdict"] == "block" and found["z"]["verdict"] == "allow"


# Quality


def test_statistics_and_base_rules(docs, clash):
    texts = ["a b c a b c x", "l one\nl one\n\nl one\n \n", "#x $%", None, "", "  ", "é\u00a0é b", " ".join(["k v"] * 40)]
    found = {r["doc_id"]: r for r in quality.judge(clash(docs(texts))).collect()}
    stat = lambda i: (found[i]["n_words"], found[i]["word_chars"], found[i]["n_symbols"], found[i]["n_dup_lines"], found[i]["n_repeat_words"])
    assert stat(0) == (7, 7, 0, 0, 6)
    assert stat(1) == (6, 12, 0, 2, 6)
    assert stat(2) == (2, 4, 3, 0, 0)
    assert stat(3) == stat(4) == stat(5) == (0, 0, 0, 0, 0)
    assert stat(6) == (2, 4, 0, 0, 0)
    assert stat(7)[4] == 80 and all(r["base_failed"] and not r["kept"] and r["distance"] is None for r in found.values())
    assert quality.judge(docs([]).limit(0)).count() == 0


def regular(inner, factor):
    floors = np.array(list(quality.FLOORS.values()))
    return inner.mean(axis=0), np.cov(inner.T, bias=True) * factor + np.diag(floors**2)


def factors(rows):
    """Centre and covariance of each estimated group."""
    d = range(quality.DIMS)
    lower = lambda r: np.array([[r[f"l{i}{j}"] if j <= i else 0.0 for j in d] for i in d])
    return {r["key"]: (np.array([r[f"m{i}"] for i in d]), lower(r) @ lower(r).T) for r in rows}


def test_the_least_determinant_of_all_subsets(spark):
    """Of small groups, every subset of the covered size is tried."""
    tables = {}
    for g in range(6):
        r = np.random.default_rng(g)
        x = np.vstack([r.normal([5, 0.3, 0.4, 0.3], [0.5, 0.1, 0.15, 0.1], (10, 4)), r.normal([9, 0.9, 1.2, 0.6], [0.5, 0.1, 0.15, 0.1], (2, 4))])
        tables[f"g{g}"] = x
    df = spark.createDataFrame([(k, *map(float, v)) for k, x in tables.items() for v in x], "key string, x0 double, x1 double, x2 double, x3 double")
    found = factors(quality.estimate(df).collect())
    for k, x in tables.items():
        best = min((np.linalg.det(regular(x[list(c)], quality.CONSISTENT)[1]), c) for c in itertools.combinations(range(12), 9))
        assert np.linalg.det(found[k][1]) <= best[0] * 1.35, k
        assert np.abs(found[k][0] - x[:10].mean(axis=0)).max() < 0.6, k


def test_outliers_are_far_from_a_third_of_bad_rows(spark):
    r = np.random.default_rng(5)
    clean = r.normal([4.5, 0.05, 0.05, 0.1], [0.4, 0.02, 0.02, 0.05], (600, 4))
    bad = r.normal([4.5, 0.7, 0.05, 0.1], [0.4, 0.02, 0.02, 0.05], (200, 4))
    x = np.abs(np.vstack([clean, bad]))
    df = spark.createDataFrame([("g", *map(float, v)) for v in x], "key string, x0 double, x1 double, x2 double, x3 double")
    (centre, cov) = factors(quality.estimate(df).collect())["g"]
    far = np.sqrt(np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre))
    assert far[:600].max() < 4 < far[600:].min()
    rows = df.join(quality.estimate(df), "key").select("x1", quality._distance().alias("d")).orderBy("x1").collect()
    assert np.abs(np.array([r["d"] for r in rows]) - far[np.argsort(x[:, 1])]).max() < 1e-6


def test_chi_squared():
    assert abs(quality.chi2_quantile(0.05, 2) - 9.4877) < 1e-3 and abs(quality.chi2_quantile(0.25, 2) - 5.3853) < 1e-3


# Toxicity


def test_folding_and_matching():
    assert toxicity.fold("Ｉd1ОT, it's 5o!") == " idiot it s so "
    assert toxicity.fold(None) == toxicity.fold(" !? ") == "  "
    lexicon = toxicity.Lexicon({" trash ": 2.0, " idio": 3.0}, ("trash can",), 0.1)
    assert lexicon.density("you idiots") == 1.5
    assert lexicon.density("the trash can is full") == 0
    assert lexicon.density("trash trash") == 2.0
    assert lexicon.density("thetrash xidiot") == 0
    assert abs(toxicity.Lexicon({" a ": 0.5}, (), 0.5).score("a") - 0.7) < 1e-9 and lexicon.score("") == 0


def test_learned_terms_and_held_out_accuracy(docs, spark):
    r = random.Random(2)
    vocabulary = [f"{a}{b}o" for a in ("ba", "du", "ki", "mo", "re", "si") for b in ("la", "no", "pe", "tu", "vi", "zo")]
    rows, labels = [], []
    for i in range(600):
        ws = [r.choice(vocabulary) for _ in range(r.choice([20, 60]))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                ws.insert(r.randrange(len(ws)), r.choice(["grobian", "grobi4ns", "GROBIАNE", "schuft"]))
        rows.append((i, " ".join(ws)))
        labels.append((i, 1, int(bad)))
    hot = [(1000 + i, "all copies of one odd toxic text with rare words") for i in range(300)]
    labels += [(i, 1, 1) for i, _ in hot]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    df = docs(rows + hot + [(5000, None), (5001, "")])
    lexicon = toxicity.learn(df, table.where("doc_id % 3 <> 1"))
    assert not any("copies" in t for t in lexicon.terms)
    found = {x["doc_id"]: x["score"] for x in toxicity.score(df, lexicon).collect()}
    assert found[5000] == found[5001] == 0
    held = [(found[i] >= 0.7) == bool(bad) for i, _, bad in labels if i % 3 == 1 and i < 1000]
    assert sum(held) / len(held) > 0.97
    assert toxicity.learn(df, table.limit(0)).terms == {}
    assert toxicity.score(docs([]).limit(0), lexicon).count() == 0


# The pipeline


def test_stages_take_effect_and_keep_the_columns(spark, docs, tmp_path):
    import corpus_pipeline

    r = random.Random(7)
    words = [f"{a}{b}" for a in ("the", "with", "over", "under", "water") for b in ("ing", "ed", "er", "ly", "ness", "ful")]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    item, passage = say(14), say(60)
    texts = [say(80) for _ in range(30)]
    texts += [texts[0], texts[1] + " end", "1234 5678", say(30) + " " + item + " " + say(30), say(40) + " " + passage + " " + say(40), say(45) + " " + passage + " " + say(41), None]
    docs(texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        at = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append({x["doc_id"]: x["text"] for x in at.collect()})
        assert i == 4 or at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    language, near, repeats, clean, mixed = kept
    assert set(language) == set(range(len(texts))) - {32, 36}
    assert set(near) == set(language) - {30, 31}
    assert set(repeats) == set(near) and passage in repeats[34] and passage not in repeats[35]
    assert set(clean) == set(repeats) - {33} and set(mixed) <= set(clean)
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == at.count()
