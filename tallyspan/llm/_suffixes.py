"""Suffix arrays of one shard: Larsson-Sadakane refinement, then common prefixes after Kasai, in numpy."""

from __future__ import annotations

import numpy as np

#: Bytes that the first sort compares at once; the eighth of its key holds how many there are.
FIRST = 7


def suffix_array(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of every piece in order, and the packed first bytes of each.

    ``ends`` holds for each position the end of its piece; a suffix ends with
    its piece and, of equal suffixes, the earlier position comes first.  Ranks
    follow Larsson and Sadakane: a group's rank is its last index, and each
    round sorts only groups still open, by the rank ``reach`` bytes further on,
    doubling ``reach``.
    """
    n = len(data)
    left = (ends - np.arange(n)).astype(np.int32)
    two = np.append(data, np.zeros(FIRST + 1, np.uint8)).astype(np.uint64)
    two = (two[:-1] << np.uint64(8)) | two[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    key = (four[:n] << np.uint64(32)) | (four[4 : n + 4] & np.uint64(0xFFFFFF00))
    del two, four
    tail = np.flatnonzero(left < FIRST)
    key[tail] &= ~((np.uint64(1) << (np.uint64(64) - np.uint64(8) * left[tail].astype(np.uint64))) - np.uint64(1))
    key |= np.minimum(left, FIRST + 1).astype(np.uint64)

    def in_place(these: np.ndarray, by: np.ndarray, done: np.ndarray) -> None:
        """Of suffixes that are equal as wholes, the earlier position first."""
        at = np.flatnonzero(done)
        these[at] = these[at][np.lexsort((these[at], by[at]))]

    order = np.argsort(key)
    k = key[order]
    short = (k & np.uint64(255)) <= FIRST
    in_place(order, k, short)
    new = np.ones(n + 1, bool)
    new[1:n] = (k[1:] != k[:-1]) | short[1:]
    del k, short
    rank = np.empty(n, np.int32)

    def number(at: np.ndarray, fresh: np.ndarray) -> None:
        """Give the suffixes at these indices the last index of their group; ``fresh`` marks first members and the end."""
        starts = np.flatnonzero(fresh)
        rank[order[at]] = np.repeat(at[starts[1:] - 1], np.diff(starts))

    number(np.arange(n), new)
    open_at = np.flatnonzero(~(new[:-1] & new[1:]))
    reach = FIRST
    while len(open_at):
        these = order[open_at]
        further = rank[np.minimum(these + reach, n - 1)]
        further += 1
        further[left[these] <= reach] = 0
        both = rank[these].astype(np.uint64)
        both <<= np.uint64(32)
        both |= further.astype(np.uint64)
        by = np.argsort(both)
        these, both = these[by], both[by]
        done = (both & np.uint64(0xFFFFFFFF)) == 0
        in_place(these, both, done)
        order[open_at] = these
        fresh = np.ones(len(these) + 1, bool)
        fresh[1:-1] = (both[1:] != both[:-1]) | done[1:]
        number(open_at, fresh)
        open_at = open_at[~(fresh[:-1] & fresh[1:])]
        reach *= 2
    return order, key


def common_prefixes(data: np.ndarray, ends: np.ndarray, order: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How many bytes each suffix shares with the one before it in ``order``.

    Kasai's observation in its permuted form: where the bytes before a suffix
    and before its predecessor agree, its value is one less than its left
    neighbour's.  So only the other positions are compared, seven bytes at a
    time, and their values run on to the right.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    position = np.arange(n)
    left = ends - position
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    starts = np.append(True, ends[1:] != ends[:-1])
    known = np.zeros(n, bool)
    known[1:] = (before[1:] > 0) & ~starts[1:] & ~starts[np.maximum(before[1:], 0)] & (data[:-1] == data[np.maximum(before[1:] - 1, 0)])
    # A value runs on only if the left neighbour has a predecessor too, which agreement of the bytes implies; the first suffix has none.
    look = np.flatnonzero(~known & (before >= 0))
    shared = np.zeros(n, np.int64)
    other = before[look]
    most = np.minimum(left[look], left[other])
    done = np.zeros(len(look), np.int64)
    active = np.arange(len(look))
    while len(active):
        a, b, o = look[active], other[active], done[active]
        step = np.minimum(most[active] - o, FIRST)
        x = (key[np.minimum(a + o, n - 1)] ^ key[np.minimum(b + o, n - 1)]) >> np.uint64(8)
        equal = np.full(len(active), FIRST)
        for j in range(FIRST - 1, -1, -1):
            equal[(x >> np.uint64(8 * (FIRST - 1 - j))) & np.uint64(255) != 0] = j
        got = np.minimum(equal, step)
        done[active] = o + got
        active = active[(got == FIRST) & (step == FIRST)]
    shared[look] = done
    base = np.where(known, -1, position)
    base = np.maximum.accumulate(base)
    shared = np.where(known, np.maximum(shared[base] - (position - base), 0), shared)
    return shared[order]


def equal_windows(data: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of this length, and a number for each that equal windows share."""
    order, key = suffix_array(data, ends)
    shared = common_prefixes(data, ends, order, key)
    group = np.cumsum(shared < window)
    long = (ends - np.arange(len(data)))[order] >= window
    return order[long], group[long]
