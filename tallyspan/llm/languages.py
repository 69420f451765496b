"""Language identification of mixed text: script ranges, per-word scores, Viterbi with a switching penalty.

A word's script leaves only the languages seen in that script; each of those
scores the word by the hashed byte n-grams of its lower-case form; the best
path through a document's words pays for every change of language, so stray
words don't break a passage.  The path's runs are the document's labelled
spans, and the language that holds most letters is the document's.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _arrays as A
from ._base import pick, stage, table

#: Rows of each language that the model is fitted on, about; a documented bound, by hash of the id.
SAMPLE_PER_LANGUAGE = 2000
#: Labels that a model may have, a table of SLOTS numbers each on the driver; training on more is an error, so none is left out in silence.
MAX_LANGUAGES = 1000
GRAMS = (2, 3, 4, 5)
SLOTS = 1 << 16
#: Natural-log units that a change of language costs, and the most by which one word may speak against a language.
SWITCH, WORST = 12.0, 8.0
#: Bytes of text that one pass of the path search takes together.
TOGETHER = 8 << 20

LETTERS = A.byte_set([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Scripts by ranges of code points (first, last), in the basic plane.  Fixed values.
RANGES = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFB00, 0xFB06), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "syriac": ((0x700, 0x74F),),
    "thaana": ((0x780, 0x7BF),),
    "devanagari": ((0x900, 0x97F), (0xA8E0, 0xA8FF)),
    "bengali": ((0x980, 0x9FF),),
    "gurmukhi": ((0xA00, 0xA7F),),
    "gujarati": ((0xA80, 0xAFF),),
    "oriya": ((0xB00, 0xB7F),),
    "tamil": ((0xB80, 0xBFF),),
    "telugu": ((0xC00, 0xC7F),),
    "kannada": ((0xC80, 0xCFF),),
    "malayalam": ((0xD00, 0xD7F),),
    "sinhala": ((0xD80, 0xDFF),),
    "thai": ((0xE00, 0xE7F),),
    "lao": ((0xE80, 0xEFF),),
    "tibetan": ((0xF00, 0xFFF),),
    "myanmar": ((0x1000, 0x109F), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F)),
    "georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)),
    "ethiopic": ((0x1200, 0x139F), (0x2D80, 0x2DDF), (0xAB00, 0xAB2F)),
    "cherokee": ((0x13A0, 0x13FF), (0xAB70, 0xABBF)),
    "khmer": ((0x1780, 0x17FF),),
    "mongolian": ((0x1800, 0x18AF),),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)),
    "han": ((0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)),
}
#: What is no letter has the script ``none``; letters in no range above have ``other``.
SCRIPTS = ("none", *RANGES, "other")


def _script_table() -> np.ndarray:
    """The script of every code point of the basic plane."""
    letter = np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(1 << 16)])
    out = np.where(letter, len(SCRIPTS) - 1, 0).astype(np.uint8)
    for i, name in enumerate(RANGES, 1):
        for first, last in RANGES[name]:
            out[first : last + 1] = np.where(letter[first : last + 1], i, 0)
    return out


_SCRIPT = _script_table()


def _word_texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen words, each between two spaces, as one run of bytes and offsets."""
    size = ends - starts + 2
    offsets = np.append(0, np.cumsum(size))
    out = np.full(offsets[-1], 0x20, np.uint8)
    within = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size)
    inside = (within > 0) & (within < np.repeat(size, size) - 1)
    out[inside] = data[(np.repeat(starts, size) + within - 1)[inside]]
    return out, offsets


def _slots(text: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the slot of every n-gram of bytes that lies inside a word, and the word."""
    word = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    room = offsets[1:][word] - np.arange(len(text))
    for n in GRAMS:
        if len(text) < n:
            continue
        fits = np.flatnonzero(room[: len(text) - n + 1] >= n)
        yield (A.byte_grams(text, n)[fits] & np.uint64(SLOTS - 1)).astype(np.int32), word[fits]


def code_points(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each character of valid UTF-8 begins, and its code point."""
    begins = np.flatnonzero((text & 0xC0) != 0x80)
    first = text[begins].astype(np.int32)
    padded = np.append(text, np.zeros(3, np.uint8))
    tail = lambda k: padded[begins + k].astype(np.int32) & 0x3F
    two = ((first & 0x1F) << 6) | tail(1)
    three = ((first & 0x0F) << 12) | (tail(1) << 6) | tail(2)
    four = ((first & 0x07) << 18) | (tail(1) << 12) | (tail(2) << 6) | tail(3)
    return begins, np.select([first < 0x80, first < 0xE0, first < 0xF0], [first, two, three], four)


def script_of(text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The script of each word: of its characters' scripts, the last in SCRIPTS."""
    if len(offsets) == 1:
        return np.empty(0, np.uint8)
    begins, code = code_points(text)
    held = np.zeros(len(text), np.uint8)
    wide = np.where((code >= 0x20000) & (code < 0x40000), SCRIPTS.index("han"), len(SCRIPTS) - 1)
    held[begins] = np.where(code < 1 << 16, _SCRIPT[np.minimum(code, 0xFFFF)], wide)
    return np.maximum.reduceat(held, offsets[:-1])


def _unique_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    digest = A.byte_spans(data, starts, ends)
    _, index, inverse = np.unique(digest, return_index=True, return_inverse=True)
    text, offsets = _word_texts(data, starts[index], ends[index])
    return text, offsets, inverse


class Model:
    """Log-probabilities of n-gram slots, and the scripts, of each language."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        total = counts.sum(axis=1, keepdims=True)
        self.log_p = np.log((counts + 0.2) / (total + 0.2 * SLOTS)).astype(np.float32).T.copy() if languages else np.zeros((SLOTS, 0), np.float32)
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.uses = (share >= 0.01).T if languages else np.zeros((len(SCRIPTS), 0), bool)

    def scores(self, text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One row per word: how far each language lies below the best, at most WORST; zeros where no language uses the script.

        And whether the word has letters, and whether some language uses its script.
        """
        out = np.zeros((len(offsets) - 1, len(self.languages)), np.float32)
        for slots, word in _slots(text, offsets):
            order = np.searchsorted(word, np.arange(len(offsets)))
            for j in range(len(self.languages)):
                sums = np.append(np.float64(0), np.cumsum(self.log_p[slots, j], dtype=np.float64))
                out[:, j] += (sums[order[1:]] - sums[order[:-1]]).astype(np.float32)
        script = script_of(text, offsets)
        allowed = self.uses[script]
        known = allowed.any(axis=1)
        out = np.where(allowed, out, -np.inf)
        out[~known] = 0
        return np.maximum(out - out.max(axis=1, keepdims=True, initial=-np.inf), -WORST), script > 0, known


def _counts(index: dict[str, int]):
    """n-gram and script counts of a task's rows, one row per language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(index), SLOTS))
        scripts = np.zeros((len(index), len(SCRIPTS)))
        for batch in batches:
            label = np.array([index[x] for x in batch.column(1).to_pylist()], np.int64)
            for first, _, data, offsets in A.pieces(pc.utf8_lower(batch.column(0))):
                starts, ends, of = A.words(data, offsets, LETTERS)
                mine = np.repeat(label[first : first + len(of) - 1], np.diff(of))
                text, cut = _word_texts(data, starts, ends)
                np.add.at(scripts, (mine, script_of(text, cut)), 1)
                for slots, word in _slots(text, cut):
                    grams += np.bincount(mine[word] * SLOTS + slots, minlength=len(index) * SLOTS).reshape(grams.shape)
        names = [x for x, i in index.items() if scripts[i].any()]
        task = [TaskContext.get().partitionId()] * len(names)
        held = [[v[index[x]].tobytes() for x in names] for v in (grams, scripts)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(task, pa.int64()), *[pa.array(v, pa.binary()) for v in held]], names=["lang", "task", "grams", "scripts"])

    return run


def _summed(rows: pa.Table) -> pa.Table:
    held = [sum(np.frombuffer(x) for x in rows.column(c).to_pylist()).tobytes() for c in ("grams", "scripts")]
    return pa.table([rows.column("lang").slice(0, 1), rows.column("task").slice(0, 1), *[pa.array([x], pa.binary()) for x in held]], names=["lang", "task", "grams", "scripts"])


COUNTED = "lang string, task bigint, grams binary, scripts binary"
#: Tables of counts that one task adds up.
FAN = 32


def _totals(counted: DataFrame) -> DataFrame:
    """One row for each language: the tasks' tables are added as a tree, so no task holds more than FAN."""
    held = stage(counted, "gram-counts")
    wide = (held.agg(F.max("task")).first()[0] or 0) + 1
    while wide > 1:
        held = stage(held.withColumn("task", F.floor(F.col("task") / F.lit(FAN)).cast("bigint")).groupBy("lang", "task").applyInArrow(_summed, COUNTED), "gram-counts")
        wide = -(-wide // FAN)
    return held


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> Model:
    """Fit on documents with a language and a text, about ``per_language`` of each language.

    More than ``max_languages`` labels are an error.  Rows are chosen by hash of their id, so the same table gives the same
    model; a table with fewer rows of a language gives all.  A table without
    labelled text gives a model without languages.
    """
    docs = pick(docs, "doc_id", "text", "lang").where("lang is not null and text is not null")
    sizes = docs.groupBy("lang").count().limit(max_languages + 1).collect()  # bounded
    if len(sizes) > max_languages:
        raise ValueError(f"there are more than {max_languages} languages; raise max_languages, at {4 * SLOTS} bytes of memory each")
    if not sizes:
        return Model([], np.zeros((0, SLOTS)), np.zeros((0, len(SCRIPTS))))
    index = {r["lang"]: i for i, r in enumerate(sorted(sizes, key=lambda r: r["lang"]))}
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_language / r["count"]))])
    uniform = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = docs.where(uniform < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0))).select("text", "lang")
    rows = {r["lang"]: r for r in _totals(chosen.mapInArrow(_counts(index), COUNTED)).collect()}  # a table of fixed size for each language
    blank = {"grams": np.zeros(SLOTS).tobytes(), "scripts": np.zeros(len(SCRIPTS)).tobytes()}
    grams = np.array([np.frombuffer((rows.get(x) or blank)["grams"]) for x in index])
    scripts = np.array([np.frombuffer((rows.get(x) or blank)["scripts"]) for x in index])
    return Model(list(index), grams, scripts)


def best_paths(scores: np.ndarray, offsets: np.ndarray, switch: float) -> np.ndarray:
    """The language of every word on its document's best path; all documents step together, longest first."""
    n = np.diff(offsets)
    order = np.argsort(-n, kind="stable")
    begin, n = offsets[:-1][order], n[order]
    path = np.zeros(len(scores), np.int16)
    if not len(scores):
        return path
    steps = int(n[0])
    active = np.searchsorted(-n, -np.arange(steps), "left")  # documents with more words than the step's number
    came = np.empty(len(scores), np.int16)
    stay = np.ones(scores.shape, bool)
    value = np.zeros((len(n), scores.shape[1]), np.float32)
    final = np.empty(len(n), np.int16)
    k = active[0]
    value[:k] = scores[begin[:k]]
    for t in range(1, steps):
        k = active[t]
        at = begin[:k] + t
        v = value[:k]
        best = v.argmax(axis=1)
        jump = (v[np.arange(k), best] - switch)[:, None]
        stay[at] = v >= jump
        came[at] = best
        value[:k] = np.maximum(v, jump) + scores[at]
    final = value.argmax(axis=1).astype(np.int16)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = begin[:k] + t
        now = final[:k]
        path[at] = now
        if t:
            final[:k] = np.where(stay[at, now], now, came[at])
    return path


LABELLED = "doc_id bigint, lang_pred string, score double, spans array<struct<first:int,last:int,lang:string>>"


def _label(held, with_spans: bool, switch: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        share = max(1, len(model.languages) // 4)  # a word's scores take four bytes for each language
        for batch in batches:
            lettered = pc.fill_null(pc.match_substring_regex(batch.column(1), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            parts: list[tuple] = []
            size, begun = 0, 0
            for first, last, data, offsets in A.pieces(pc.utf8_lower(batch.column(1)), A.PIECE // share):
                starts, ends, of = A.words(data, offsets, LETTERS)
                weight = ends - starts
                if len(starts) and model.languages:
                    text, cut, inverse = _unique_words(data, starts, ends)
                    scores, counts, known = (x[inverse] for x in model.scores(text, cut))
                    weight = weight * counts
                else:
                    scores, known = np.zeros((len(starts), max(1, len(model.languages))), np.float32), np.zeros(len(starts), bool)
                parts.append((scores, of, weight, known))
                size += len(data)
                if size >= TOGETHER // share or last == len(batch):
                    yield _rows(model, batch.column(0).slice(begun, last - begun), lettered[begun:last], parts, with_spans, switch)
                    parts, size, begun = [], 0, last

    return run


def _rows(model: Model, ids: pa.Array, lettered: np.ndarray, parts: list[tuple], with_spans: bool, switch: float) -> pa.RecordBatch:
    shift = np.cumsum([0, *[len(p[0]) for p in parts]])
    offsets = np.concatenate([p[1][:-1] + s for p, s in zip(parts, shift, strict=False)] + [shift[-1:]])
    scores, weight, known = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3))
    path = best_paths(scores, offsets, switch)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    width = scores.shape[1]
    held = np.bincount(doc * width + path, weights=weight * known, minlength=(len(offsets) - 1) * width).reshape(-1, width)
    whole = np.bincount(doc, weights=weight, minlength=len(offsets) - 1)
    best = held.argmax(axis=1)
    sure = lettered & bool(model.languages)
    names = [model.languages[b] if s else "und" for b, s in zip(best, sure, strict=True)]
    score = np.where(sure, held.max(axis=1) / np.maximum(whole, 1), 0.0)
    spans: list[list[dict]] = [[] for _ in names]
    if with_spans and model.languages:
        new = np.flatnonzero(np.append(True, (path[1:] != path[:-1]) | (doc[1:] != doc[:-1]))[: len(path)])
        for a, b in zip(new, np.append(new[1:], len(path))[: len(new)], strict=True):
            if sure[doc[a]]:
                spans[doc[a]].append({"first": a - offsets[doc[a]], "last": b - 1 - offsets[doc[a]], "lang": model.languages[path[a]]})
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))
    return pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), pa.array(score), pa.array(spans, kind)], names=["doc_id", "lang_pred", "score", "spans"])


def label(docs: DataFrame, model: Model, with_spans: bool = True, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score, spans: the language of every whole text and its spans of words by language.

    ``score`` is the share of letters that the path gives to ``lang_pred``, the
    first by name where shares tie; letters in a script that no learned
    language uses count for none, so a text of them alone scores 0.  Words are runs of letters, counted from 0
    in spans.  A null or empty text, one without letters, and any text under a
    model without languages is ``und`` with score 0 and no spans.  Rows that
    repeat are judged alike; other columns are left out and never looked at.
    """
    texts = pick(docs, "doc_id", "text").withColumns({"doc_id": F.col("doc_id").cast("bigint"), "text": F.col("text").cast("string")})
    held = docs.sparkSession.sparkContext.broadcast(model)  # MAX_LANGUAGES tables of SLOTS numbers at most
    return texts.mapInArrow(_label(held, with_spans, switch), LABELLED)


def remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Documents whose language is known for at least ``least`` of their letters, in the columns of documents.

    The predicted language replaces a null one; a given one stays.  Null and
    empty texts, and those without letters, have none and go; rows that repeat
    stay or go together, with or without an id.
    """
    whole = pick(docs, "doc_id", "text", "lang", "source", "n_chars")
    texts = whole.select("text", "lang", "source", "n_chars", F.col("doc_id").cast("bigint").alias("doc_id"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    inner = _label(held, False, SWITCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = pa.Table.from_batches(list(inner(iter([batch.select(["doc_id", "text"])])))) if batch.num_rows else None
            if judged is None:
                continue
            known = pc.not_equal(judged.column("lang_pred"), "und")
            good = pc.and_(known, pc.greater_equal(judged.column("score"), least)).combine_chunks()
            given = pc.coalesce(batch.column("lang"), judged.column("lang_pred").combine_chunks())
            out = batch.set_column(batch.schema.get_field_index("lang"), "lang", given)
            yield out.filter(good)

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    typed = texts.select(columns[0], *[F.col(c).cast("string").alias(c) for c in columns[1:4]], F.col("n_chars").cast("bigint").alias("n_chars"))
    return typed.mapInArrow(run, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without an id is never learned from, so it counts as held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(pick(docs, "doc_id", "text", "lang").where(remainder(5) != 0))
    found = label(docs, model)
    return found.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(True)).alias("held_out"), "lang_pred", "score", "spans")
