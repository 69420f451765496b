import itertools
import random
from collections import Counter

from tallyspan import plans

plans.load()


def test_near_copies_of_any_length(spark, rows, tmp_path):
    r = random.Random(4)
    texts = []
    for n in (3, 12, 60, 219, 225, 700, 3000):
        ws = [f"w{r.randrange(400)}" for _ in range(n)]
        texts += [" ".join(ws), " ".join(ws[: n - max(1, n // 30)] + ["other"] * (n // 30)), " ".join(reversed(ws))]
    texts += [texts[0], texts[-1]]
    spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    heads = {}
    for i, t in enumerate(texts):
        heads.setdefault(t, i)
    five = lambda ws: Counter(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4)))
    sets = {i: five(t.lower().split(" ")) for t, i in heads.items()}
    bp = {(a, b): (sets[a] & sets[b]).total() * 20000 // (sets[a].total() + sets[b].total()) for a, b in itertools.combinations(sorted(sets), 2)}
    want = {k: v for k, v in bp.items() if v >= 8000}
    assert {len(texts[a]) < 200 for a, _ in want} == {True, False} and any(len(texts[a]) > 1200 for a, _ in want)
    assert rows(plans.QUERIES["near_pairs"](spark, str(tmp_path))) == sorted(((a, b, v) for (a, b), v in want.items()), key=repr)
    family = {i: i for i in sets}
    for _ in sets:
        for a, b in want:
            family[a] = family[b] = min(family[a], family[b])
    named = [family[heads[t]] for t in texts]
    found = plans.QUERIES["near_families"](spark, str(tmp_path))
    assert rows(found) == sorted(((i, f, named.count(f)) for i, f in enumerate(named) if named.count(f) > 1), key=repr)
