"""Dominators and parts of random graphs against their definition."""

import random

from tallyspan.operators import graph as G


def _reached(after, starts, without):
    seen, todo = set(), [s for s in starts if s != without]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [y for y in after.get(x, ()) if y != without]
    return seen


def plain(nodes, edges, least):
    """nodes: {node: (weight, entered, pinned, items)}; by taking every node out in turn."""
    names = sorted({*nodes, *[x for e in edges for x in e]})
    fact = lambda x: nodes.get(x, (0, None, None, 1))
    after = {}
    for a, b in edges:
        if a != b:
            after.setdefault(a, set()).add(b)
    starts = [x for x in names if fact(x)[1]] or [x for x in names if not any(x in after.get(y, ()) for y in names)]
    met = _reached(after, starts, None)
    starts = {*starts, *(x for x in names if x not in met)}
    doms = {x: {x} for x in names}
    for d in names:
        kept = _reached(after, starts, d)
        for x in names:
            if x != d and x not in kept:
                doms[x].add(d)
    total = {d: sum(fact(x)[0] for x in names if d in doms[x]) for d in names}
    items = {d: sum(fact(x)[3] for x in names if d in doms[x]) for d in names}
    whole = sum(fact(x)[0] for x in names)
    idom = {x: next((d for d in doms[x] - {x} if len(doms[d]) == len(doms[x]) - 1), None) for x in names}
    movable = {x for x in names if not fact(x)[2] and items[x] >= 2 and total[x] >= least and whole - total[x] >= least}
    parts = [x for x in movable if not any(d in movable for d in doms[x] - {x})]
    return [(x, idom[x], total[x]) for x in names], [(x, total[x], items[x]) for x in parts]


def test_two_hundred_random_graphs(spark, rows):
    rng = random.Random(7)
    nodes, edges, want, parts = [], [], [], []
    for g in range(200):
        n = rng.randrange(1, 22)
        held = {x: (rng.randrange(6), rng.random() < 0.15 if g % 3 else None, rng.random() < 0.2, rng.randrange(1, 3)) for x in range(n) if rng.random() < 0.95}
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(2 * n))]
        nodes += [(g, x, w, e, p, i) for x, (w, e, p, i) in held.items()]
        edges += [(g, a, b) for a, b in links]
        dominated, found = plain(held, links, 6)
        want += [(g, *r) for r in dominated]
        parts += [(g, *r) for r in found]
    nodes = spark.createDataFrame(nodes, "graph int, node int, weight int, entered boolean, pinned boolean, items int")
    edges = spark.createDataFrame(edges, "graph int, src int, dst int").repartition(3)
    assert rows(G.dominators(nodes, edges)) == sorted(want, key=repr)
    assert len(parts) > 20 and rows(G.largest_parts(nodes, edges, 6)) == sorted(parts, key=repr)


def test_long_chains_and_wide_graphs_take_near_linear_time(spark):
    import time

    n = 30_000
    chain = [[i + 1] for i in range(n)] + [[]]
    wide = [list(range(1, n))] + [[n - 1]] * (n - 1)
    back = [[i + 1, max(0, i - 5)] for i in range(n)] + [[]]
    began = time.time()
    assert G.immediate_dominators(chain)[1][1:] == list(range(n))
    assert set(G.immediate_dominators(wide)[1]) == {0}
    assert G.immediate_dominators(back)[1][1:] == list(range(n))
    assert time.time() - began < 20


def test_odd_graphs(spark, rows):
    nodes = spark.createDataFrame([("g", "a", 1), ("g", None, 5), ("h", "x", 2)], "graph string, node string, weight int")
    edges = spark.createDataFrame([("g", "a", "b"), ("g", "a", "b"), ("g", "b", None), ("g", "a", "a"), (None, "p", "q")], "graph string, src string, dst string")
    assert rows(G.dominators(nodes, edges)) == sorted([("g", "a", None, 1), ("g", "b", "a", 0), ("h", "x", None, 2), (None, "p", None, 0), (None, "q", "p", 0)], key=repr)
    assert G.dominators(nodes.limit(0), edges.limit(0)).collect() == []


def test_a_large_graph_is_held_as_numbers():
    """Four bytes for a number: lists and dictionaries of objects took ten times the rows' own size."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    n = 60_000
    node = np.arange(n)
    src, dst = np.append(node, (node[1:] - 1) // 2), np.append(np.zeros(n, int), node[1:])
    rows = pa.table({
        "graph": pa.array(np.zeros(2 * n - 1, np.int32)), "src": pa.array(src), "dst": pa.array(dst, mask=np.arange(2 * n - 1) < n),
        "weight": pa.array(np.ones(2 * n - 1, np.int64)), "items": pa.array(np.ones(2 * n - 1, np.int64)), "entered": pa.array(src < 0), "pinned": pa.array(src < 0),
    })
    tracemalloc.start()
    out = G._dominated(2, ["graph", "node", "idom", "total", "items", "part"])(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    held = dict(zip(out.column("node").to_pylist(), out.column("total").to_pylist(), strict=True))
    assert held[0] == n and held[n - 1] == 1
    assert peak < 100 * 2 * n, peak
