import random
import re

import numpy as np
import pytest

from tallyspan.llm import contamination, near_copies
from tallyspan.llm._components import components


def family(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.choice([30, 60, 120]))] for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base[:6]:
        for _ in range(6):
            c = list(b)
            for _ in range(r.randint(0, 4)):
                c[r.randrange(len(c))] = r.choice(vocabulary)
            texts.append(" ".join(c).upper() if r.random() < 0.2 else " ".join(c))
    texts += ["", None, "one two", "ONE  two", "one", " \n"]
    r.shuffle(texts)
    return texts


def brute(texts, width, percent):
    sets = []
    for t in texts:
        ws = (t or "").encode().lower().split()
        sets.append({tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)} or ({tuple(ws)} if ws else set()))
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return [(i, len(s), root[i], root[i] == i) for i, s in enumerate(sets)]


@pytest.mark.parametrize("block", [2000, 3])
def test_groups_against_brute_force(docs, rows, monkeypatch, block):
    texts = family(block)
    whole = near_copies.rest
    monkeypatch.setattr(near_copies, "rest", lambda o, s, p: whole(o, s, p, block))
    assert sorted(rows(near_copies.near_copies(docs(texts), 4, 80))) == brute(texts, 4, 80)


def test_blocks_alone_find_every_link(docs, rows, monkeypatch):
    """Without the star and the best partner, the comparison by blocks links all."""
    texts = family(9)
    monkeypatch.setattr(near_copies, "confirmed", lambda pairs, sets, percent: pairs.limit(0).toDF("u", "v"))
    whole = near_copies.rest
    monkeypatch.setattr(near_copies, "rest", lambda o, s, p: whole(o, s, p, 4))
    assert sorted(rows(near_copies.near_copies(docs(texts), 4, 80))) == brute(texts, 4, 80)


def test_one_of_each_group_stays(docs, clash):
    text = " ".join(f"w{i}" for i in range(80))
    kept = near_copies.keep_one_each(clash(docs([(3, text), (1, text), (2, text + " end"), (None, "no id"), (9, None), (4, "other words here")])))
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 4, 9]
    judged = near_copies.near_copies(docs([(3, text), (None, text), (5, text)]))
    assert sorted(map(repr, (tuple(r) for r in judged.collect()))) == ["(3, 76, 3, True)", "(5, 76, 3, False)", "(None, 76, None, True)"]
    assert near_copies.near_copies(docs([]).limit(0)).count() == 0


def test_signatures_estimate_without_bias():
    r = np.random.default_rng(1)
    pool = r.integers(0, 1 << 63, 1500).astype(np.uint64) * np.uint64(2)
    a, b = np.sort(pool[:1000]), np.sort(pool[500:])
    s = near_copies.signatures(np.array([0, 1000, 2000]), np.concatenate([a, b]))
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.12


def test_components(spark, rows):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(7, 7)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(40)]
    found = dict(rows(components(spark.createDataFrame(edges, "a bigint, b bigint"))))
    root = {}
    for x, y in edges:
        for v in (x, y):
            root.setdefault(v, v)
    for _ in range(100):
        for x, y in edges:
            root[x] = root[y] = min(root[x], root[y])
    assert found == root
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return W.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(text, items, n):
    ws, hit, named = words(text), set(), set()
    for name, item in items:
        iw = words(item)
        k = min(n, len(iw))
        for s in range(len(iw) - k + 1 if k else 0):
            for p in range(len(ws) - k + 1):
                if ws[p : p + k] == iw[s : s + k]:
                    hit.update(range(p, p + k))
                    named.add(str(name))
    return sorted(hit), sorted(named)


def test_contamination_against_brute_force(docs, spark, clash):
    r = random.Random(5)
    vocabulary = [f"v{i}" for i in range(12)] + ["É", "straße"]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, say(r.choice([1, 3, 6, 9, 14]))) for i in range(9)] + [(20, None), (21, "!!"), (3, say(8))]
    texts = [say(r.choice([0, 5, 60])) + " " + items[r.randrange(9)][1] if r.random() < 0.5 else say(30) for _ in range(20)]
    texts += [None, "", "A" * 50, items[4][1].upper().replace(" ", "--")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    found = {x["doc_id"]: x for x in contamination.judge(clash(docs(texts)), table, 5).collect()}
    for i, t in enumerate(texts):
        assert (found[i]["n_words"], (found[i]["hits"], found[i]["items"])) == (len(words(t)), brute_hits(t, items, 5)), i
    assert contamination.judge(docs(texts), table.limit(0), 5).where("size(hits) > 0").count() == 0
    assert contamination.judge(docs([]).limit(0), table, 5).count() == 0
    twice = contamination.judge(docs([(1, "x"), (1, "x"), (None, items[4][1])]), table, 5)
    assert twice.count() == 3


def test_clean_documents_and_proximity(docs, spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id bigint, text string")
    hit, near = "so alpha beta gamma delta epsilon zeta eta theta iota kappa on", "alpha beta gamma delta odd epsilon zeta eta theta iota kappa"
    df = docs([(1, hit), (2, near), (3, "alpha kappa"), (None, "clean")])
    assert sorted((r["doc_id"] or 0) for r in contamination.clean_documents(df, items).collect()) == [0, 2, 3]
    gaps = {(r["doc_id"], r["gap"]) for r in contamination.proximity_matches(df, items, 3).collect()}
    assert (1, 0) in gaps and {d for d, _ in gaps} <= {1, 2, 3}
