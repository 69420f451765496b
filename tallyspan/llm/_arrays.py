"""Whole-batch numpy primitives over UTF-8 bytes: words, digests of spans, winnowed anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_PRIME = 0x9E3779B97F4A7C15
#: Bytes of text that the per-byte arrays cover at once; a longer document is taken whole.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix finalizer)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The digest of two digests in this order.

    Every step mixes anew: sums of powers modulo 2**64, as rolling digests
    have them, cancel out on structured strings (Thue and Morse's among them).
    """
    return mix(a * U64(_PRIME) + b)


def _sized(digests: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    return mix(digests + np.asarray(n).astype(U64) * U64(0xD6E8FEB86659FD93))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every byte on as one number, the first the least; zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), "<u8", padded, strides=(1,)).astype(U64)


def byte_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Digests of spans of bytes: of up to eight bytes the bytes themselves, mixed; of more, two blocks of 8, 16, 32 ... that cover the span."""
    out = np.zeros(len(starts), U64)
    n = ends - starts
    held = _eights(data)
    short = np.flatnonzero((n <= 8) & (n > 0))
    keep = U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - U64(8) * n[short].astype(U64))
    out[short] = held[starts[short]] & keep
    width, most = 8, int(n.max(initial=0))
    if most > 8:
        held = mix(held)
    while width < most:
        some = np.flatnonzero((n > width) & (n <= 2 * width))
        out[some] = joined(held[starts[some]], held[ends[some] - width])
        if 2 * width < most:
            held = joined(held[:-width], held[width:])
        width *= 2
    return _sized(out, n)


def byte_grams(data: np.ndarray, k: int) -> np.ndarray:
    """The digest of every k consecutive bytes."""
    held = _eights(data)
    if k <= 8:
        return _sized(held[: max(0, len(data) - k + 1)] & U64((1 << (8 * k)) - 1), k)
    held, width = mix(held), 8
    while 2 * width < k:
        held = joined(held[:-width], held[width:])
        width *= 2
    n = max(0, len(data) - k + 1)
    return _sized(joined(held[:n], held[k - width : k - width + n]), k)


class Digests:
    """Digests of spans of a sequence of mixed 64-bit values, each of two blocks of 1, 2, 4 ... values that cover the span."""

    def __init__(self, values: np.ndarray):
        self._levels = [values]

    def _level(self, j: int) -> np.ndarray:
        while len(self._levels) <= j:
            held, width = self._levels[-1], 1 << (len(self._levels) - 1)
            self._levels.append(joined(held[:-width], held[width:]))
        return self._levels[j]

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = ends - starts
        out = np.zeros(len(n), U64)
        j = 0
        while n.max(initial=0) >= 1 << j:
            some = np.flatnonzero((n >= 1 << j) & (n < 2 << j))
            if len(some):
                held = self._level(j)
                out[some] = joined(held[starts[some]], held[ends[some] - (1 << j)])
            j += 1
        return _sized(out, n)

    def grams(self, k: int) -> np.ndarray:
        """The digest of every k consecutive values."""
        n = max(0, len(self._levels[0]) - k + 1)
        if not n:
            return np.empty(0, U64)
        j = k.bit_length() - 1
        held = self._level(j)
        return _sized(joined(held[:n], held[k - (1 << j) : k - (1 << j) + n]), k)


def pieces(texts: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents as (first, last, bytes, offsets); null is empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def byte_set(inside) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(inside)] = True
    return out


#: Words are runs of anything but space and the five ASCII controls from tab to carriage return.
SPACED = ~byte_set([0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the offset of each document's words; words never cross documents."""
    n = len(data)
    if n == 0:
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    here = inside[data]
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = here
    cut = offsets[offsets < n]
    begins = here & ~before[:-1]
    begins[cut] = here[cut]
    starts = np.flatnonzero(begins)
    after = np.zeros(n, bool)
    after[:-1] = here[1:]
    tail = offsets[1:][offsets[1:] > 0] - 1
    after[tail] = False
    ends = np.flatnonzero(here & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, by doubling."""
    out, reach = values, 1
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    return np.minimum(out[: len(out) - (width - reach)], out[width - reach :]) if reach < width else out


def winnow(grams: np.ndarray, offsets: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor every window of ``window`` units at the rightmost least k-gram in it.

    Returns (document, first, last, anchor): the windows that start at
    first..last of a document all have that anchor.  Every window of every
    document belongs to exactly one row, and which gram anchors a window
    depends on the window's content alone.
    """
    lengths = offsets[1:] - offsets[:-1]
    docs = np.flatnonzero(lengths >= window)
    none = np.empty(0, np.int64)
    if not len(docs):
        return none, none, none, none
    width = window - k + 1
    least = sliding_min(grams, width)
    n = len(least)
    edge = np.zeros(n + 1, np.int8)
    begin, stop = offsets[docs], offsets[docs + 1] - window
    edge[begin] += 1
    edge[stop + 1] -= 1
    valid = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    enters = grams[width - 1 : width - 1 + n] == least
    turn = enters.copy()
    turn[1:] |= least[1:] != least[:-1]
    turn[begin] = True
    turn &= valid
    first = np.flatnonzero(turn)
    doc = docs[np.searchsorted(begin, first, "right") - 1]
    last = np.minimum(np.append(first[1:], n) - 1, offsets[doc + 1] - window)
    anchor = first + width - 1
    look = np.flatnonzero(~enters[first])
    if len(look):
        around = grams[first[look][:, None] + np.arange(width - 1, -1, -1)]
        anchor[look] -= np.argmin(around, axis=1)
    return doc, first, last, anchor


def runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as disjoint ascending spans; spans that touch are joined."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.append(True, starts[1:] > reach[:-1]))
    return starts[new], reach[np.append(new[1:] - 1, len(starts) - 1)]
