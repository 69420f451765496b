import random

import pytest
from pyspark.sql import functions as F

from tallyspan.operators import joins as J
from tallyspan.operators import measures as M
from tallyspan.operators import sequences as S
from tallyspan.operators.ranks import ranked


@pytest.mark.parametrize("hot", [0, 400])
def test_places_against_a_plain_sort(spark, rows, hot):
    r = random.Random(hot)
    data = [(r.choice(["a", "b", None]), r.choice([None, *range(9)]), i) for i in range(120)] + [("hot", r.randrange(1000), 1000 + i) for i in range(hot)]
    table = spark.createDataFrame(data, "k string, v int, id int").repartition(5)
    found = ranked(table, ["k"], [F.desc("v"), F.asc("id")], "rn", "n")
    want = []
    for k in {d[0] for d in data}:
        group = sorted((d for d in data if d[0] == k), key=lambda d: (d[1] is None, -(d[1] or 0), d[2]))
        want += [(*d, i + 1, len(group)) for i, d in enumerate(group)]
    assert rows(found) == sorted(want, key=repr)


def test_a_hot_key_is_cut_into_ranges(spark):
    table = spark.range(40000).select(F.lit("hot").alias("k"), "id")
    found = ranked(table, ["k"], [F.desc("id")])
    assert found.where("rn <> 40000 - id").count() == 0
    ranges = table.withColumn("_tie", F.xxhash64("k", "id")).repartitionByRange(4, F.col("k"), F.desc("id"), "_tie").groupBy(F.spark_partition_id()).count()
    assert max(c for _, c in ranges.collect()) < 20000


def test_equal_rows_and_empty_tables(spark, rows):
    assert sorted(x for *_, x in rows(ranked(spark.createDataFrame([(1, 2)] * 7, "k int, v int"), ["k"], [F.asc("v")]))) == [*range(1, 8)]
    assert rows(ranked(spark.createDataFrame([], "k int, v int"), ["k"], [F.asc("v")], "rn", "n")) == []


def test_pairing_and_groups_of_a_hot_key(spark, rows):
    r = random.Random(2)
    left, right = [("h", float(r.randrange(50)), i) for i in range(300)], [("h", float(r.randrange(50)), i) for i in range(260)]
    df = lambda x: spark.createDataFrame(x, "k string, s double, t int")
    a, b = (sorted((x[1] for x in side), reverse=True) for side in (left, right))
    assert rows(J.worst_with_worst(df(left), df(right), ["k"], "s", "t")) == sorted((("h", i + 1, a[i], b[i] if i < 260 else None) for i in range(300)), key=repr)
    assert rows(J.zip_within(df(left), df(right), ["k"], "s")) == []
    assert len(rows(J.zip_within(df(left), df(left), ["k"], "s"))) == 300
    parts = [p for *_, p in rows(S.stride_groups(df(left), "k", "t"))]
    assert sorted(parts.count(p) for p in set(parts)) == [30] * 10
    beyond, unused = M.kth_excused(df(left), df(left[:297]), ["k"], "t")
    assert sorted(x[2] for x in rows(beyond)) == [297, 298, 299] and rows(unused) == []
