import random

from tallyspan import plans

plans.load()


def test_graphs_of_every_row(spark, rows, tmp_path):
    r = random.Random(5)
    items = [(r.randrange(12), r.randrange(70), 1 + r.randrange(7), float(r.randrange(1, 51)), 0.05) for _ in range(60)]
    spark.createDataFrame(items, "l_suppkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = {(a, b) for a, b, *_ in items if a != b}

    def closed(edges):
        pairs = set(edges)
        while more := {(a, d) for a, b in pairs for c, d in edges if b == c} - pairs:
            pairs |= more
        return pairs

    assert rows(plans.QUERIES["feature_closure"](spark, str(tmp_path))) == sorted(closed(edges), key=repr)
    longer = {(a, d) for a, b in edges for c, d in closed(edges) if b == c and b != d}
    assert rows(plans.QUERIES["reachable_other_way"](spark, str(tmp_path))) == sorted(longer, key=repr)
    orders = [(200 + i, r.randrange(220), 10.0) for i in range(40)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    part = {x: x for o in orders for x in o[:2]}
    for _ in part:
        for a, b, _ in orders:
            part[a] = part[b] = min(part[a], part[b])
    assert rows(plans.QUERIES["linked_components"](spark, str(tmp_path))) == sorted(part.items(), key=repr)
