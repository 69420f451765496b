"""The whole toxicity query against a plain version: terms, threshold and scores without Spark and without an automaton."""

import math
import random
import zlib
from collections import Counter

import pytest

from tallyspan.llm import toxicity


def _plain_density(text, terms, exceptions):
    folded = toxicity.fold(text)
    if not terms or len(folded) <= 2:
        return 0.0
    covered = set()
    for phrase in map(toxicity.fold, exceptions):
        for s in range(len(folded)):
            if folded.startswith(phrase, s):
                covered |= set(range(s, s + len(phrase) - 1))
    starts = [i for i, c in enumerate(folded[:-1]) if c == " "]
    heaviest = {s: max((w for t, w in terms.items() if folded.startswith(t, s)), default=0.0) for s in starts}
    return sum(w for s, w in heaviest.items() if s not in covered) / len(starts)


def _plain_lexicon(texts, exceptions):
    """Terms, and the threshold found by trying every level."""
    uses = set()
    for text, toxic in texts:
        ws = toxicity.fold(text).split()
        uses |= {(w, left, right, toxic) for w, left, right in zip(ws, ["", *ws], [*ws[1:], ""])}
    a, b = Counter(), Counter()
    for w, _, _, toxic in uses:
        for t in [f" {w} ", *(f" {w[:k]}" for k in toxicity.STEMS if len(w) >= k)]:
            (a if toxic else b)[t] += 1
    a_all = sum(u[3] for u in uses)
    b_all = len(uses) - a_all
    share = a_all / (a_all + b_all)
    part = lambda x, n, p: x * math.log(x / (n * p)) if x else 0.0
    least = math.log(len({*a, *b}) + 1) + toxicity.EVIDENCE
    strong = {t for t in {*a, *b} if part(a[t], a[t] + b[t], share) + part(b[t], a[t] + b[t], 1 - share) > least and a[t] > 4 * share / (1 - share) * (b[t] + 0.5)}
    goes_on = {t: max((a[x] for x in strong if x != t and x.startswith(t)), default=0) for t in strong}
    terms = {t: math.log((a[t] + 0.5) / (a_all + 1)) - math.log((b[t] + 0.5) / (b_all + 1)) for t in strong if goes_on[t] < 0.9 * a[t]}
    pairs = [(_plain_density(x, terms, exceptions), toxic) for x, toxic in texts]
    levels = sorted({d for d, _ in pairs if d > 0})
    cuts = [(levels[0] / 16, levels[0]), *zip(levels, levels[1:])]
    wrong = [sum((d >= upper) != bool(toxic) for d, toxic in pairs) for _, upper in cuts]
    lower, upper = cuts[wrong.index(min(wrong))]
    return terms, math.sqrt(lower * upper)


def test_the_whole_query_against_a_plain_version(spark, tmp_path):
    r = random.Random(8)
    vocabulary = [f"{x}{y}o" for x in ("ba", "du", "ki", "mo", "re", "si") for y in ("la", "no", "pe", "tu", "vi", "zo")]
    rows, labels = [], []
    for i in range(420):
        ws = [r.choice(vocabulary) for _ in range(r.choice([8, 20, 60]))]
        toxic = int(i % 4 == 0)
        for _ in range(r.choice([2, 4]) if toxic else int(r.random() < 0.05)):
            ws.insert(r.randrange(len(ws)), r.choice(["grobian", "grobi4ns", "GROBIАNE", "schuft", "schuftig"]))
        if r.random() < 0.2:
            ws.insert(r.randrange(len(ws)), toxicity.EXCEPTIONS[r.randrange(len(toxicity.EXCEPTIONS))])
        rows.append((i, r.choice([" ", ", ", "\n"]).join(ws)))
        labels.append((i, toxic))
    rows += [(900, None), (901, ""), (902, "?! 77"), (903, "grobian"), (904, "schuft " * 3000), (7, rows[7][1])]
    labels += [(8000, 1), (900, 0), (3, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    marked = {i: toxic for i, toxic in reversed(labels) if toxic is not None}
    terms, threshold = _plain_lexicon([(t, marked[i]) for i, t in dict(rows).items() if i in marked and not held(i)], toxicity.EXCEPTIONS)
    assert any(t.endswith("n ") or t == " grobi" or t.startswith(" schuft") for t in terms)
    found = sorted((tuple(x) for x in toxicity.query(spark, str(tmp_path)).select("doc_id", "held_out", "score", "predicted").collect()))
    assert [(i, h) for i, h, *_ in found] == sorted((i, held(i)) for i, _ in rows)
    texts = dict(rows)
    for i, _, score, predicted in found:
        d = _plain_density(texts[i], terms, toxicity.EXCEPTIONS) if i != 904 else None
        if d is None:
            assert score > 0.9
        else:
            assert score == pytest.approx(d / (d + threshold * 3 / 7) if d else 0.0, rel=1e-9), i
        assert predicted == int(score >= 0.7)
