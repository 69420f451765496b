import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyspan.operators import lean


def _plain(files, least):
    """The merges of small files: all runs by definition, then one sorted list gone through."""
    at = defaultdict(list)
    for k, ls in sorted(files.items()):
        for p in range(len(ls)):
            for n in range(1, len(ls) - p + 1):
                at[tuple(ls[p : p + n])].append((k, p + 1))
    runs = set()
    for k, ls in files.items():
        for p in range(len(ls)):
            longest = max((n for n in range(1, len(ls) - p + 1) if len(at[tuple(ls[p : p + n])]) > 1), default=0)
            run = tuple(ls[p : p + longest])
            before = lambda f, q: files[f][q - 2] if q > 1 else None
            same = sum(before(*s) == before(k, p + 1) for s in at[run])
            if longest >= least and (p == 0 or same == 1):
                runs.add(run)
    found = []
    for run in runs:
        kept = []
        for k, p in at[run]:
            if not kept or kept[-1][0] != k or p >= kept[-1][1] + len(run):
                kept.append((k, p))
        n, size = len(kept), len(run)
        row = len({k for k, _ in kept}) == 1 and all(b - a == size for (_, a), (_, b) in zip(kept, kept[1:]))
        saves = max(0, size * (n - 1) - n - (1 if row else 3))
        if n > 1 and saves >= 1:
            found.append((-saves, kept[0], -size, "table" if row else "function", kept))
    taken, chosen = set(), []
    for saves, _, size, kind, kept in sorted(found):
        cells = {(k, q) for k, p in kept for q in range(p, p - size)}
        if not cells & taken:
            taken |= cells
            chosen.append((-saves, -size, kind, kept))
    return chosen


def _table(spark, files):
    return spark.createDataFrame([(k, i + 1, x) for k, ls in files.items() for i, x in enumerate(ls)], "file string, line int, text string")


@pytest.mark.parametrize("seed", [1, 2])
def test_merges_and_report_against_one_list(spark, rows, seed):
    r = random.Random(seed)
    parts = [[f"{p}{i}" for i in range(r.randrange(4, 9))] for p in "abc"]
    files = {}
    for f in range(5):
        ls = []
        for _ in range(5):
            part = r.choice(parts)
            ls += part[r.randrange(2) : len(part) - r.randrange(2)] if r.random() < 0.8 else [f"own{r.randrange(999)}"]
        files[f"f{f}"] = ls
    files["t"] = ["x", "y", "z", "w"] * 4 + ["end"]
    want = _plain(files, 3)
    found = lean.merges(_table(spark, files), "file", "line", F.col("text"))
    assert rows(found.drop("run")) == sorted(((k, p, size, len(kept), kind, saves) for saves, size, kind, kept in want for k, p in kept), key=repr)
    split = defaultdict(lambda: [0, 0])
    for saves, _, _, kept in want:
        for i, (k, _) in enumerate(kept):
            split[k][0] += saves // len(kept) + (saves % len(kept) if i == 0 else 0)
            split[k][1] += 1
    assert want and rows(lean.report(found, "file")) == sorted(((k, *v) for k, v in split.items()), key=repr)


def test_nothing_repeats(spark, rows):
    found = lean.merges(_table(spark, {"a": ["1", "2", "3"], "b": ["4"]}), "file", "line", F.col("text"))
    assert rows(found) == [] and rows(lean.report(found, "file")) == []
