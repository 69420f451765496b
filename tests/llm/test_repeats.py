import hashlib
import random

import numpy as np
import pytest

from tallyspan.llm import _arrays as A
from tallyspan.llm import byte_repeats, word_repeats
from tallyspan.llm._suffixes import common_prefixes, equal_windows, suffix_array


def corpus(seed, words=("la", "le", "lu", "éa", "b")):
    r = random.Random(seed)
    base = [" ".join(r.choice(words) for _ in range(r.choice([0, 3, 40, 90, 200]))) for _ in range(14)]
    texts = base + [base[3], base[4] + " x " + base[5], "y" + base[6][7:], base[7] * 3, "a" * 450, "ab" * 300, "", None, "\n\t ", base[2].replace("la", "le", 1)]
    r.shuffle(texts)
    return texts


def brute_bytes(texts, n):
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - n + 1):
            w = raw[i : i + n]
            if w in seen:
                gone[i : i + n] = b"\1" * n
            seen.add(w)
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(texts, n):
    first, out = {}, []
    rows = [(t or "").encode().split() for t in texts]
    for i, ws in enumerate(rows):
        for s in range(len(ws) - n + 1):
            first.setdefault(tuple(ws[s : s + n]), i)
    for i, ws in enumerate(rows):
        gone = [False] * len(ws)
        for s in range(len(ws) - n + 1):
            if first[tuple(ws[s : s + n])] < i:
                gone[s : s + n] = [True] * n
        out.append((len(ws), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(ws, gone, strict=True) if not g)).hexdigest()))
    return out


def digest(kept, spans):
    return len(spans), hashlib.sha256(bytes(kept)).hexdigest()


@pytest.mark.parametrize("shard_bytes", [2 << 20, 900])
def test_bytes_against_brute_force(docs, monkeypatch, shard_bytes):
    texts = corpus(1)
    whole = byte_repeats.repeats
    monkeypatch.setattr(byte_repeats, "repeats", lambda d, w: whole(d, w, gram=12, shard_bytes=shard_bytes))
    found = {r["doc_id"]: r for r in byte_repeats.remove_repeats(docs(texts), 40).collect()}
    got = [(r["n_bytes"], sum(s["last"] - s["first"] for s in r["spans"]), *digest(r["kept"], r["spans"])) for r in (found[i] for i in range(len(texts)))]
    assert got == brute_bytes(texts, 40)


def test_words_against_brute_force(docs):
    texts = corpus(2)
    found = {r["doc_id"]: r for r in word_repeats.remove_repeats(docs(texts), 12, 4).collect()}
    got = [(r["n_words"], r["n_removed"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in (found[i] for i in range(len(texts)))]
    assert got == brute_words(texts, 12)


def test_odd_tables(docs, clash, spark):
    assert byte_repeats.remove_repeats(docs([]).limit(0)).count() == 0
    assert word_repeats.remove_repeats(docs([]).limit(0)).count() == 0
    text = " ".join(f"w{i}" for i in range(120))
    df = clash(docs([(None, text), (5, text), (5, text), (6, None)]))
    words = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"]) for r in word_repeats.remove_repeats(df).collect())
    assert words == [(False, 5, 120), (False, 5, 120), (False, 6, 0), (True, 0, 0)]
    found = byte_repeats.remove_repeats(df).collect()
    assert sorted((r["doc_id"] or 0, len(r["kept"])) for r in found) == [(0, len(text)), (5, 0), (5, 0), (6, 0)]
    clean = byte_repeats.clean_documents(df)
    assert clean.columns == ["doc_id", "text", "lang", "source", "n_chars"] and clean.count() == 4


def test_characters_go_as_a_whole(docs):
    text = "é" * 200
    (first, second) = sorted(byte_repeats.clean_documents(docs(["x" + "abc" * 60, "é" + "abc" * 60 + "é"])).collect(), key=lambda r: r["doc_id"])
    assert second["text"] == "éé" or second["text"] == "é" + "é"
    assert first["n_chars"] == len(first["text"])
    assert byte_repeats.clean_documents(docs([text])).first()["text"].encode().decode() is not None


@pytest.mark.parametrize("seed", range(6))
def test_suffix_arrays(seed):
    r = random.Random(seed)
    pieces = [bytes(r.choice(b"ab\x00") for _ in range(r.randint(1, 60))) for _ in range(r.randint(1, 9))] + [b"ab" * 30, b"ab" * 30]
    data, stops = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([len(p) for p in pieces])
    ends = np.repeat(stops, [len(p) for p in pieces])
    order, key = suffix_array(data, ends)
    text = data.tobytes()
    tails = [text[i : ends[i]] for i in order]
    assert [(t, i) for t, i in zip(tails, order, strict=True)] == sorted((text[i : ends[i]], i) for i in range(len(text)))

    def shared(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    assert common_prefixes(data, ends, order, key).tolist() == [0] + [shared(tails[i - 1], tails[i]) for i in range(1, len(tails))]
    at, group = equal_windows(data, ends, 7)
    by = {}
    for i, g in zip(at, group, strict=True):
        by.setdefault(g, set()).add(text[i : i + 7])
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({text[i : i + 7] for i in range(len(text)) if ends[i] - i >= 7})


def test_every_window_has_one_anchor_of_its_own_content():
    import pyarrow as pa

    texts = [t or "" for t in corpus(3)]
    for _, _, data, offsets in A.pieces(pa.array(texts)):
        grams = A.byte_grams(data, 8)
        doc, first, last, anchor = A.winnow(grams, offsets, 30, 8)
        seen, by_text = set(), {}
        for d, a, b, at in zip(doc, first, last, anchor, strict=True):
            for s in range(a, b + 1):
                assert (d, s) not in seen and s <= at <= s + 22
                seen.add((d, s))
                assert by_text.setdefault(data[s : s + 30].tobytes(), at - s) == at - s
        assert len(seen) == sum(max(0, n - 29) for n in np.diff(offsets))
