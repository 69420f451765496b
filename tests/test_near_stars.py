import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from tallyspan.operators import similar as S


def _families(sets, least):
    """Families by all pairs."""
    part = {k: k for k in sets}
    near = [(a, b) for a, b in itertools.combinations(sets, 2) if (sets[a] & sets[b]).total() * 20000 // (sets[a].total() + sets[b].total()) >= least]
    for a, b in near * 2:
        lo, hi = sorted((part[a], part[b]))
        part = {k: lo if v == hi else v for k, v in part.items()}
    return sorted((k, v) for k, v in part.items() if sum(x == v for x in part.values()) > 1)


def test_drifting_chains_are_one_family(spark, rows):
    """Each member is near its neighbours alone, so stars leave most links to the comparison across components."""
    r = random.Random(3)
    data = []
    for chain in range(4):
        words = [f"c{chain}w{i}" for i in range(90)]
        data += [(100 * chain + i, words[3 * i : 3 * i + 30]) for i in range(20)]
    data += [(900 + i, [f"n{r.randrange(60)}" for _ in range(12)]) for i in range(40)] + [(990, []), (991, None)]
    r.shuffle(data)
    found = S.linked(spark.createDataFrame(data, "id bigint, ts array<string>"), "id", F.col("ts"), 8000)
    assert rows(found) == sorted(_families({k: Counter(ts or []) for k, ts in sorted(data) if ts}, 8000), key=repr)


def test_a_family_of_copies_costs_a_star(spark):
    words = [f"w{i}" for i in range(40)]
    data = [(i, words[:38] + [f"own{i}", f"other{i}"]) for i in range(400)]
    table = spark.createDataFrame(data, "id bigint, ts array<string>")
    sets, prefix = S._prefixes(table, "id", F.col("ts"), 8000)
    stars = S._starred(prefix, 8000)
    assert stars.count() < 400
    parts = S.components(S._scored(stars, sets, 8000))
    assert S._across(prefix, parts, 8000).count() == 0
    assert {tuple(r) for r in S.linked(table, "id", F.col("ts"), 8000).collect()} == {(i, 0) for i in range(400)}
