"""Canonical trees against a plain recursion."""

import random

from tallyspan.operators import trees

SCHEMA = "tree string, node string, parent string, place int, kind string, name string"


def _plain(rows):
    by = {}
    for t, node, parent, place, kind, name in rows:
        by.setdefault(t, {}).setdefault(parent, []).append((place, node, kind, name))
    out = {}
    for t, children in by.items():
        seen = {}

        def form(x):
            _, node, kind, name = x
            at = None if name is None else seen.setdefault(name, len(seen))  # noqa: B023
            return (kind, at, tuple(form(y) for y in sorted(children.get(node, ()), key=lambda y: y[:2])))  # noqa: B023

        out[t] = tuple(form(r) for r in sorted(children.get(None, ()), key=lambda y: y[:2]))
    return {t: f for t, f in out.items() if f}


def test_random_trees_meet_where_forms_are_equal(spark):
    rng = random.Random(3)
    rows = []
    for t in range(150):
        n = rng.randrange(1, 7)
        names = rng.sample("abcdef", 3)
        for i in range(n):
            parent = None if i == 0 else str(rng.randrange(i))
            rows.append((f"t{t}", str(i), parent, rng.randrange(3), rng.choice("pq"), rng.choice([None, *names])))
    want = _plain(rows)
    found = {r["tree"]: r for r in trees.canonical(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert found.keys() == want.keys()
    by = {}
    for t, f in want.items():
        by.setdefault(f, set()).add(found[t]["digest"])
    assert all(len(d) == 1 for d in by.values()) and len({next(iter(d)) for d in by.values()}) == len(by)
    assert len(by) < len(want)
    copies = {r["tree"]: r["value"] for r in trees.copies(trees.canonical(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert copies == {t: sum(f == g for g in want.values()) - 1 for t, f in want.items()}


def test_renamed_trees_meet_and_other_shapes_do_not(spark):
    def tree(t, *leaves):
        return [(t, "r", None, 0, "f", None), *[(t, f"l{i}", "r", i, k, n) for i, (k, n) in enumerate(leaves)]]

    rows = [
        *tree("a", ("id", "x"), ("id", "y"), ("id", "x")), *tree("b", ("id", "y"), ("id", "x"), ("id", "y")), *tree("c", ("id", "x"), ("id", "y"), ("id", "y")), *tree("d", ("id", "x"), ("id", "y")),
        *tree("e", ("id", "x"), ("lit", None), ("id", "x")), ("f", "lost", "nowhere", 0, "id", "x"),
    ]
    found = {r["tree"]: r["digest"] for r in trees.canonical(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found["a"] == found["b"] and len({found[t] for t in "acde"}) == 4 and "f" not in found
    assert trees.canonical(spark.createDataFrame([], SCHEMA)).collect() == []
