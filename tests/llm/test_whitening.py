"""Whitened components against the plain covariance of the distinct vectors."""

import math

import numpy as np
import pytest

from tallyspan.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def _usable(vectors):
    return [(i, v) for i, v in vectors if v is not None and all(e is not None and math.isfinite(e) for e in v)]


def check(found, vectors, components=16):
    """Compare with numpy on whole numbers and doubles; signs are free, but one for all rows."""
    rows = _usable(vectors)
    x = np.array([[math.floor(64 * float(np.float32(e))) + 1000000 for e in v] for _, v in rows], object)
    fit = np.array(sorted({tuple(r) for r in x}), object)
    n, s = len(fit), fit.sum(axis=0)
    centred = np.array(fit * n - s, np.float64) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    k = min(components, x.shape[1])
    assert len(found) == k * len(rows)
    by = {}
    for r in found:
        by.setdefault(r["component"], {}).setdefault(r["vec_id"], r)
    for c in range(k):
        of = by[c + 1]
        want = (np.array(x * n - s, np.float64) / n) @ basis[:, c] / math.sqrt(values[c])
        got = np.array([of[i]["whitened"] for i, _ in rows])
        assert np.abs(got - want).max() < 1e-6 or np.abs(got + want).max() < 1e-6
        for (i, _), row in zip(rows, x, strict=True):
            assert of[i]["deviation"] == sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True))
            assert of[i]["n"] == n
            assert abs(of[i]["explained"] - values[c] / values.sum()) < 1e-9
    assert len({r["identity_error"] for r in found}) == 1
    assert found[0]["identity_error"] < 1e-4


@pytest.mark.parametrize(("d", "tile"), [(20, 32), (20, 6), (7, 3)])
def test_against_numpy(spark, d, tile):
    rng = np.random.default_rng(d)
    vectors = [(i, (rng.standard_normal(d) * np.linspace(3, 0.2, d)).astype(np.float32).tolist()) for i in range(200)]
    vectors += [(300 + i, vectors[0][1]) for i in range(100)]  # one vector in a third of the rows
    vectors += [(500, None), (501, [1.0, None] + [0.0] * (d - 2)), (502, [math.nan] * d), (503, [math.inf] + [0.0] * (d - 1))]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], SCHEMA).repartition(5)
    check(whitening.whiten(df, tile=tile).collect(), vectors)


def test_many_tasks_add_as_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "TASK_BYTES", 200)
    monkeypatch.setattr(whitening, "FAN", 3)
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 64)
    rng = np.random.default_rng(3)
    vectors = [(i, rng.standard_normal(6).astype(np.float32).tolist()) for i in range(60)]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], SCHEMA)
    check(whitening.whiten(df, tile=2).collect(), vectors)


def test_flat_components_and_odd_tables(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (None, [1.0, 2.0], 1)], SCHEMA)
    found = whitening.whiten(same).collect()
    assert len(found) == 6 and {r["whitened"] for r in found} == {None} and {r["deviation"] for r in found} == {0} and {r["n"] for r in found} == {1}
    assert {r["identity_error"] for r in found} == {0.0}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i], 1) for i in range(5)], SCHEMA)
    found = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.whiten(line).collect()}
    assert found[2, 1] == pytest.approx(0.0, abs=1e-6) and abs(found[0, 1]) == pytest.approx(2**0.5) and found[0, 2] is None
    for rows in ([], [(1, None, 1)], [(1, [], 1)], [(1, [1e30], 1)]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []
    mixed = spark.createDataFrame([(1, [1.0], 1), (2, [1.0, 2.0], 1), (3, [2.0, 2.0], 1)], SCHEMA).selectExpr("*", "5 as D", "6 as y", "7 as EMBEDDING")
    assert {r["vec_id"] for r in whitening.whiten(mixed).collect()} == {2, 3}


def test_deviations_beyond_a_long():
    y, sums = np.array([[2**30, -(2**30)], [0, 0]], np.int32), np.array([5, 7])
    assert whitening._deviations(y, sums, 10**6) == [None, 74]
    assert whitening._deviations(y, sums, 1) == [(2**30 - 5) ** 2 + (2**30 + 7) ** 2, 74]
