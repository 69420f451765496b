"""The manifest against a plain recomputation, over many small parts, and against its SQL."""

import hashlib
import random
import zlib

import pytest

from tallyspan.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _leaf(row, text):
    doc, _, lang, source, n = row
    return _h(*map(_field, (doc, source, lang, n, text)))


def _tree(level):
    levels = [level]
    while len(level) > 1:
        level = [_h(*level[i : i + 3]) for i in range(0, len(level), 3)]
        levels.append(level)
    return levels


def _climb(levels, i, digest):
    seen = []
    for level in levels[:-1]:
        a = i // 3 * 3
        run = list(level[a : a + 3])
        seen += [x for k, x in enumerate(run) if a + k != i]
        run[i - a] = digest
        digest, i = _h(*run), i // 3
    return digest, seen


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for rs in by.values():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r, r[1])))
    trees = [_tree([_leaf(r, r[1]) for r in by[s]]) for s in names]
    top = _tree([t[-1][0] for t in trees])
    root = top[-1][0]
    out = []
    for s, (name, tree) in enumerate(zip(names, trees, strict=True)):
        for i, r in enumerate(by[name]):
            low, a = _climb(tree, i, tree[0][i])
            _, b = _climb(top, s, low)
            bad = r[1]
            if bad is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                bad = bad.replace("\n", "")
            again, _ = _climb(top, s, _climb(tree, i, _leaf(r, bad))[0])
            out.append((r[0], tree[0][i], low, root, _h(*a, *b), again, again == root))
    return sorted(out, key=repr)


def _rows(n, seed, sources):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "one line", "two\nlines", "ü\n\n", "x" * 5000 + "\n"])
        source = sources[0] if rng.random() < 0.4 else rng.choice(sources)
        rows.append((i * 7 % n, text, rng.choice([None, "de"]), source, rng.choice([None, 0, 12])))
    return rows


@pytest.mark.parametrize(("n", "rows", "fan", "sources"), [(1, 8, 2, ["a"]), (2, 1, 2, [None]), (100, 7, 2, ["hot", None, "", "é", "z", "b", "c"]), (250, 9, 3, [f"s{i}" for i in range(90)]), (81, 1000, 4, ["a"])])
def test_against_a_plain_tree(spark, n, rows, fan, sources):
    data = _rows(n, n, sources)
    found = merkle.manifest(spark.createDataFrame(data, SCHEMA).repartition(3), rows, fan).collect()
    assert sorted(map(tuple, found), key=repr) == plain(data)


def test_tampering_is_found_and_clean_documents_verify(spark):
    data = [(i, f"a\nb{i}", "en", "s", 3) for i in range(30)]
    found = {r["doc_id"]: r for r in merkle.manifest(spark.createDataFrame(data, SCHEMA), 4, 2).collect()}
    for i, r in found.items():
        assert r["verified"] == (zlib.crc32(str(i).encode()) % 2 != 0)
        assert r["verified"] == (r["folded_root"] == r["root"])


def test_null_ids_repeats_clashing_columns_and_an_empty_table(spark):
    data = [(None, "a\n", None, None, None), (None, "b", "x", None, 1), (5, "t", "x", "s", 1), (5, "t", "x", "s", 1), (5, "u", "x", "s", 1)]
    df = spark.createDataFrame(data, SCHEMA)
    more = df.selectExpr("*", "1 as Part", "'q' as LEAF", "2 as salt", "3 as grp", "4 as TEXT")
    found = merkle.manifest(more, 2, 2).collect()
    assert sorted(map(tuple, found), key=repr) == plain(data)
    empty = merkle.manifest(df.limit(0))
    assert empty.collect() == [] and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_merging_is_associative():
    leaves = {(0, 0, i): bytes([i]) * 32 for i in range(20)} | {(1, 0, i): bytes([100 + i]) * 32 for i in range(5)}
    sizes = {0: 20, 1: 5, merkle.TOP: 2}
    keys = list(leaves)

    def fragment(part):
        nodes = {k: leaves[k] for k in part}
        merkle.settle(nodes, sizes)
        return nodes

    def merge(x, y):
        nodes = x | y
        merkle.settle(nodes, sizes)
        return nodes

    for cut in ((3, 11), (1, 2), (17, 22)):
        a, b, c = (fragment(p) for p in (keys[: cut[0]], keys[cut[0] : cut[1]], keys[cut[1] :]))
        left, right = merge(merge(a, b), c), merge(a, merge(b, c))
        assert left == right == fragment(keys)
        assert list(left) == [(merkle.TOP, 1, 0)]


def test_sql_on_a_fixture(spark):
    import duckdb
    import pandas as pd

    data = _rows(60, 3, ["hot", None, "é", "b", "z"])
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(data, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"n_chars": "Int64"}))
    assert sorted(con.execute(merkle.SQL).fetchall(), key=repr) == plain(data)
