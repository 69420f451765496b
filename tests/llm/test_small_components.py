import random

import pytest

from tallyspan.llm import _components


def links(seed):
    r = random.Random(seed)
    return [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (1060, 1000)]


def parts(pairs):
    root = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in root:
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    return root


def test_few_links_need_no_rounds(spark, rows, monkeypatch):
    """Each round is several small jobs; on a table dealt over many partitions they took most of the time."""
    monkeypatch.setattr(_components, "_star", None)
    pairs = links(1)
    df = spark.createDataFrame(pairs, "u bigint, v bigint").repartition(5)
    assert dict(rows(_components.components(df))) == parts(pairs)
    assert _components.components(df.limit(0)).collect() == []


@pytest.mark.parametrize("here", [0, 40])
def test_more_links_go_by_rounds(spark, rows, monkeypatch, here):
    monkeypatch.setattr(_components, "HERE", here)
    pairs = links(2)
    df = spark.createDataFrame(pairs, "u bigint, v bigint").repartition(5)
    assert dict(rows(_components.components(df))) == parts(pairs)
