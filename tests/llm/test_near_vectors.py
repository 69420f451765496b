"""Linked vectors against all pairs, with a hot group, copies, odd vectors and the SQL."""

import math

import numpy as np
import pytest

from tallyspan.llm import near_vectors as V

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, least=V.LEAST):
    n = len(rows)
    good = [i for i, (_, v, l) in enumerate(rows) if l is not None and v and all(e is not None and math.isfinite(e) for e in v) and any(v)]
    links = {i: set() for i in range(n)}
    for a in good:
        for b in good:
            x, y = (np.array(rows[i][1], np.float32).astype(float) for i in (a, b))
            if a != b and rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                links[a].add(b)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            fresh = links[todo.pop()] - seen
            seen |= fresh
            todo += fresh
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        group = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), group, rows[i][0] == group))
    return sorted(out, key=repr)


def _near(rng, centre, spread):
    v = centre + rng.standard_normal(len(centre)) * spread / math.sqrt(len(centre))
    return (v / np.linalg.norm(v)).astype(np.float32).tolist()


def _planted(seed, d, n):
    rng = np.random.default_rng(seed)
    unit = lambda: (lambda v: v / np.linalg.norm(v))(rng.standard_normal(d))
    rows = [(_near(rng, unit(), 0.0), int(rng.integers(3))) for _ in range(n)]
    hot = unit()
    rows += [(_near(rng, hot, 0.1), 1) for _ in range(n // 3)]  # a third of all rows near one centre
    for _ in range(n // 20):
        v = unit()
        rows += [(_near(rng, v, s), 2) for s in (0.0, 0.1, 0.14, 0.3)]
    rows += [(rows[0][0], rows[0][1])] * 9 + [([3 * x for x in rows[0][0]], rows[0][1]), (rows[0][0], 7), (rows[0][0], None)]
    order = rng.permutation(len(rows))
    return [(int(i), *rows[j]) for i, j in enumerate(order)]


@pytest.mark.parametrize(("seed", "d", "n"), [(1, 64, 240), (2, 5, 120), (3, 200, 120)])
def test_all_pairs(spark, seed, d, n, rows):
    data = _planted(seed, d, n)
    found = rows(V.near_vectors(spark.createDataFrame(data, SCHEMA).repartition(5)))
    want = plain(data)
    assert sum(r[1] for r in found) >= 0.98 * sum(r[1] for r in want)
    assert [r[0] for r in found] == [r[0] for r in want] and all(a[1] <= b[1] for a, b in zip(found, want, strict=True))  # no link below the threshold, none twice


@pytest.mark.parametrize("d", [16, 64, 768])
def test_recall_at_the_threshold(d):
    """Pairs barely over the threshold, the hardest to find, against their true cosines."""
    rng = np.random.default_rng(d)
    a, b = rng.standard_normal((2, 3000, d))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    c = rng.uniform(V.LEAST, V.LEAST + 0.002, 3000)[:, None]
    label = np.arange(3000).astype(np.uint64)
    met = V.first_meeting(V.cells(a, label), V.cells(c * a + np.sqrt(1 - c * c) * b, label)) != V._NONE
    assert met.mean() >= 0.995


def test_blocks_and_small_shards_change_nothing(spark, rows, monkeypatch):
    data = _planted(4, 64, 300)
    want = rows(V.near_vectors(spark.createDataFrame(data, SCHEMA)))
    monkeypatch.setattr(V, "BLOCK_BYTES", 16 << 10)
    monkeypatch.setattr(V, "SHARD_BYTES", 20_000)
    assert rows(V.near_vectors(spark.createDataFrame(data, SCHEMA))) == want


def test_odd_vectors(spark, rows):
    one, two = [1.0, 0.0, 0.0], [1.0, 0.01, 0.0]
    data = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0, 0.0], 1), (4, [math.nan, 1.0, 1.0], 1), (5, [math.inf, 1.0, 1.0], 1), (6, [None, 1.0, 0.0], 1), (7, one, None), (8, one, None), (9, one, 1), (9, one, 1), (10, two, 1)]
    data += [(11, [1.0, 0.0], 1), (12, [1e-30, 0.0, 0.0], 1), (13, [3e38, 0.0, 0.0], 1), (None, two, 1), (None, two, 2), (14, [-1.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(data, SCHEMA)
    want = plain([r for r in data if r[0] != 12])
    found = rows(V.near_vectors(df.where("vec_id is null or vec_id <> 12").selectExpr("*", "1 as node", "2 as K", "3 as LABEL", "4 as n")))
    assert found == want
    assert (12, 5, 9, False) in rows(V.near_vectors(df))
    assert V.near_vectors(df.limit(0)).collect() == []
    double = df.selectExpr("vec_id", "cast(embedding as array<double>) as embedding", "cast(label as string) as label")
    assert rows(V.near_vectors(double)) == rows(V.near_vectors(df))


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(0)
    y = rng.standard_normal((200, 8)) * 3
    points = V.lattice_point(y)
    assert len(V.neighbours()) == 240 and np.allclose((V.neighbours() ** 2).sum(axis=1), 2)
    far = ((y - points) ** 2).sum(axis=1)
    around = ((y[:, None] - points[:, None] - V.neighbours()) ** 2).sum(axis=2)
    assert (far[:, None] <= around + 1e-9).all()  # the nearest of a lattice point's neighbours bounds its cell


def test_sql_on_a_fixture():
    import duckdb
    import pandas as pd

    data = [r for r in _planted(5, 16, 60) if r[1]]
    con = duckdb.connect()
    con.register("embeddings", pd.DataFrame(data, columns=["vec_id", "embedding", "label"]).astype({"label": "Int64"}))
    assert sorted(con.execute(V.SQL).fetchall(), key=repr) == plain(data)
