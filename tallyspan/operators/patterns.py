"""Many patterns at once: one automaton over all phrases or prefixes, then the tests at a hit's edges.

The cost of a text grows with its length and its hits, not with the number of
patterns.  A task builds the automaton once, from a list that the caller holds.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import glob_regex


def _automaton(words: list[str]) -> ahocorasick.Automaton:
    """All words, each with the places where it stands in the list."""
    held: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        if not w:
            raise ValueError("an empty pattern stands everywhere")
        held.setdefault(w, []).append(i)
    out = ahocorasick.Automaton()
    for w, at in held.items():
        out.add_word(w, (len(w), tuple(at)))
    if held:
        out.make_automaton()
    return out


@lru_cache(maxsize=1 << 16)
def _wordy(c: str) -> bool:
    return c in "_-" or unicodedata.category(c)[0] in "LN"


def stands_alone(text: str, first: int, last: int) -> bool:
    """Whether a hit is no part of a longer word: not after a letter, digit, ``_``, ``-`` or ``.``, nor before one of the first four."""
    return (first == 0 or not (_wordy(text[first - 1]) or text[first - 1] == ".")) and (last == len(text) or not _wordy(text[last]))


def _in_tasks(rows: DataFrame, key: str, more: list, name: str, find: Callable[[], Callable[..., list[str]]]) -> DataFrame:
    """key, name: a row for each finding in the columns ``more`` of a row; ``find`` is built once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_in = find()
        for batch in batches:
            index, names = [], []
            for i, values in enumerate(zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True)):
                got = found_in(*values)
                names += got
                index += [i] * len(got)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), pa.array(names, pa.string())], names=[key, name])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, *more).mapInArrow(run, f"`{key}` {kind}, {name} string")


def phrases_in(rows: DataFrame, key: str, rules: list[dict], text: str = "text", path: str | None = None) -> DataFrame:
    """key, phrase: the forbidden phrases of each row's text, once each, in any case.

    A rule has ``text``, ``word`` (whole words, else anywhere) and, where
    ``path`` names a column, ``in`` and ``except`` globs.  Null texts hold
    none; an empty phrase is an error.
    """
    wanted = [r["text"].lower() for r in rules]
    scopes = [tuple(tuple(r.get(side) or ()) for side in ("in", "except")) for r in rules]
    _automaton(wanted)  # so that a wrong rule fails here and not in a task

    def find():
        words, fits = _automaton(wanted), lru_cache(maxsize=1 << 12)(lambda glob: re.compile(glob_regex(glob)))

        @lru_cache(maxsize=1 << 14)
        def inside(rule: int, where: str | None) -> bool:
            include, exclude = scopes[rule]
            any_of = lambda globs: where is not None and any(fits(g).search(where) for g in globs)
            return (not include or any_of(include)) and not any_of(exclude)

        def found_in(line: str | None, where: str | None = None) -> list[str]:
            if not line or not wanted:
                return []
            met: dict[int, None] = {}
            for last, (size, at) in words.iter(line):
                alone = None
                for i in at:
                    if i in met:
                        continue
                    if rules[i].get("word"):
                        alone = stands_alone(line, last + 1 - size, last + 1) if alone is None else alone
                        if not alone:
                            continue
                    if path is None or inside(i, where):
                        met[i] = None
            return list(dict.fromkeys(rules[i]["text"] for i in sorted(met)))

        return found_in

    return _in_tasks(rows, key, [F.lower(text), *([F.col(path)] if path else [])], "phrase", find)


_TAIL = re.compile(r"[A-Za-z0-9_\-]*")


def shapes_in(rows: DataFrame, key: str, text: str, shapes: list[dict]) -> DataFrame:
    """key, name: a row for each credential-like word of a text.

    A shape has ``name``, ``prefix``, ``tail`` (the fewest letters, digits,
    ``_`` or ``-`` after it) and perhaps ``documented`` tails that are no
    finding.  A prefix counts at the start of a word alone, in its own case.
    """
    _automaton([s["prefix"] for s in shapes])

    def find():
        words = _automaton([s["prefix"] for s in shapes])
        documented = [frozenset(s.get("documented", ())) for s in shapes]

        def found_in(line: str | None) -> list[str]:
            if not line or not shapes:
                return []
            out, free = [], {}
            for last, (size, at) in words.iter(line):
                first = last + 1 - size
                if first and _TAIL.fullmatch(line, first - 1, first):
                    continue
                tail = _TAIL.match(line, last + 1).group()
                for i in at:
                    if len(tail) >= shapes[i]["tail"] and first >= free.get(i, 0):
                        free[i] = last + 1 + len(tail)
                        if tail not in documented[i]:
                            out.append(shapes[i]["name"])
            return out

        return found_in

    return _in_tasks(rows, key, [F.col(text)], "name", find)
