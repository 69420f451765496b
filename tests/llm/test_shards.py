"""What shards decide, without Spark: the operators have no other way to find a repeat."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tallyspan.llm import _arrays as A
from tallyspan.llm import _repeats as R
from tallyspan.llm import byte_repeats, word_repeats


def pieces(rows, wide):
    h, part, doc, first, raw = zip(*rows, strict=True)
    return pa.table(
        [pa.array(h, pa.int64()), pa.array(part, pa.int32()), pa.array([wide] * len(h)), pa.array(doc, pa.int64()), pa.array(first, pa.int32()), pa.array(raw, pa.binary())],
        names=["h", "part", "wide", "doc", "first", "bytes"],
    )


def test_suffixes_decide_copies_too():
    r = random.Random(1)
    text = bytes(r.choice(b"abcd") for _ in range(60))
    got = byte_repeats.sort_shard(40)(pieces([(1, 0, 9, 5, text), (1, 0, 3, 7, text), (1, 0, 3, 90, b"x" + text[1:])], False)).to_pylist()
    assert sorted((r["doc"], r["first"], r["last"]) for r in got) == [(3, 91, 110), (9, 5, 25)]


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_parts_of_an_anchor_merge_to_what_one_shard_finds(parts):
    r = random.Random(parts)
    text = bytes(r.choice(b"abcd") for _ in range(50))
    rows = [(1, 0, d, r.randrange(100), text[: r.randint(42, 50)] + bytes(r.choice(b"xy") for _ in range(3))) for d in range(40)]
    one = byte_repeats.sort_shard(40)(pieces(rows, False)).to_pylist()
    dealt = [[(h, p, *rest) for (h, _, *rest), p in zip(rows, [i % parts for i in range(len(rows))], strict=True) if p == q] for q in range(parts)]
    found = pa.concat_tables([byte_repeats.sort_shard(40)(pieces(d, True)) for d in dealt])
    kept = found.filter(found.column("merge"))
    merged = R.merge_shards(False)(kept).to_pylist() + found.filter(pa.compute.invert(found.column("merge"))).to_pylist()
    starts = lambda rows: sorted((x["doc"], s) for x in rows for s in range(x["first"], x["last"] + 1))
    assert starts(merged) == starts(one) and starts(one)


@pytest.mark.parametrize("seed", range(4))
def test_matches_grow_both_ways(seed):
    """Every window of places with a common seed, against all windows compared as tuples."""
    r = random.Random(seed)
    rest, width = 6, 3
    rows = [[r.randint(1, 2) for _ in range(rest)] + [7, 8, 9] + [r.randint(1, 2) for _ in range(rest)] for _ in range(30)]
    words = A.mix(np.array(rows, np.uint64).ravel())
    seat = np.arange(len(rows)) * (2 * rest + width) + rest
    least, most = np.array([r.randint(0, 2) for _ in rows]), np.array([r.randint(3, rest) for _ in rows])
    place, left, key = word_repeats.extended(words, seat, least, most, np.zeros(len(rows), bool), width, rest)
    got = {}
    for p, n, k in zip(place, left, key, strict=True):
        got.setdefault(k, set()).add((int(p), int(n)))
    want = {}
    for p, row in enumerate(rows):
        for n in range(least[p], most[p] + 1):
            want.setdefault((n, tuple(row[rest - n : 2 * rest - n + width])), set()).add((p, n))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_shards_are_cut_by_bytes_between_parts():
    rows = pieces([(h, p, d, 0, b"z" * 10) for h in range(5) for p in range(2) for d in range(7)], False)
    sizes = []

    def sort(t):
        sizes.append(t.num_rows)
        assert len(set(zip(t.column("h").to_pylist(), t.column("part").to_pylist(), strict=True))) == t.num_rows // 7
        return t

    out = list(R.stream_shards(sort, "bytes", 200)(iter(rows.to_batches(max_chunksize=4))))
    assert sum(sizes) == 70 and set(sizes) == {21, 7} and sum(b.num_rows for b in out) == 70


def test_repeated_ids_with_other_texts_keep_what_stands_once(docs):
    r = random.Random(5)
    p, tail, other = (" ".join(f"{k}{r.randrange(10**6)}" for _ in range(60)) for k in "ptx")
    rows = [(1, p), (2, p + " " + tail), (2, other), (None, other + " " + tail)]
    words = {(x["doc_id"], x["text"]) for x in word_repeats.remove_repeats(docs(rows)).collect()}
    assert words == {(1, p), (2, ""), (None, other + " " + tail)}  # what has no id comes first
    whole = [(1, p), (2, p + " " + tail), (2, other)]
    assert {(x["doc_id"], x["text"]) for x in word_repeats.remove_repeats(docs(whole)).collect()} == {(1, p), (2, tail), (2, other)}
    assert {x["kept"].decode().strip() for x in byte_repeats.remove_repeats(docs(whole)).collect()} == {p, tail, other}


def test_an_absent_column_is_an_error(spark):
    with pytest.raises(ValueError, match="no column text"):
        byte_repeats.remove_repeats(spark.createDataFrame([(1,)], "doc_id bigint"))
