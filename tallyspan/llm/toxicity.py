"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text and normalised by length.

Text is folded before anything else: lower case, no loose accents, letters that
look like Latin ones and digits that stand for letters become those letters, and
all else becomes space.  Lexicon terms are whole words and beginnings of words that
labelled toxic text uses significantly more often than other text; a term's
weight is its log-odds.  Matches inside an exception phrase don't count.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import pick, stage, table

#: Labelled rows of each class that the lexicon is learned from, chosen by hash of the id; a documented bound.
SAMPLE_PER_CLASS = 4000
#: Lengths of the word beginnings that may become terms.
STEMS = range(3, 10)
#: Nats of log-likelihood, beyond the log of the number of candidates, that a term's excess in toxic text needs.
EVIDENCE = 5.0
#: Phrases in which a term is meant otherwise.
EXCEPTIONS = ("trash can", "trash bin", "scum line", "clown fish", "class clown", "disgusting smell")

#: Letters that look like Latin ones, and digits and signs that stand for letters.  Fixed values.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɡ": "g", "ı": "i", "ł": "l",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
}


class _Folding(dict):
    """Code point to folded text, filled as characters occur."""

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKC", chr(code).lower()):
            if unicodedata.combining(c):
                continue
            c = LOOKALIKES.get(c, c)
            out += c if c.isalpha() else " "
        if not out and unicodedata.category(chr(code)) not in ("Mn", "Cf"):
            out = " "
        self[code] = out
        return out


_FOLD = _Folding()


def fold(text: str | None) -> str:
    """Folded words between single spaces, with a space at either end."""
    return f" {' '.join((text or '').translate(_FOLD).split())} "


class Lexicon:
    """Weighted terms, exception phrases, and the density of weight at which a text counts as toxic."""

    def __init__(self, terms: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS, threshold: float = 1.0):
        self.terms, self.exceptions, self.threshold = terms, exceptions, threshold
        self._machine = None

    def __getstate__(self):
        return {"terms": self.terms, "exceptions": self.exceptions, "threshold": self.threshold, "_machine": None}

    def machine(self):
        if self._machine is None:
            made = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                made.add_word(term, (weight, len(term)))
            for phrase in self.exceptions:
                made.add_word(fold(phrase), (0.0, len(fold(phrase))))
            made.make_automaton()
            self._machine = made
        return self._machine

    def density(self, text: str | None) -> float:
        """Weight matched per word; each word counts its heaviest term once."""
        folded = fold(text)
        if not self.terms or len(folded) <= 2:
            return 0.0
        heaviest: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (weight, size) in self.machine().iter(folded):
            start = end - size + 1
            if weight == 0.0:
                excused.append((start, end))
            elif weight > heaviest.get(start, 0.0):
                heaviest[start] = weight
        excused.sort()
        total, at, reach = 0.0, 0, -1
        for start in sorted(heaviest):  # one sweep over both
            while at < len(excused) and excused[at][0] <= start:
                reach = max(reach, excused[at][1])
                at += 1
            if start >= reach:
                total += heaviest[start]
        return total / folded.count(" ", 1)

    def score(self, text: str | None) -> float:
        """0 without a match, 0.7 at the threshold, towards 1 beyond."""
        d = self.density(text)
        return d / (d + self.threshold * 3 / 7) if d else 0.0


def sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """text, toxic: at most ``per_class`` labelled documents of each class, chosen by hash of the id; of rows that repeat an id, the least text."""
    labels = pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null")
    labels = labels.groupBy(F.col("doc_id").cast("bigint").alias("_doc")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    some = [labels.where(F.col("toxic") == c).orderBy(F.xxhash64("_doc")).limit(per_class) for c in (0, 1)]
    ids = F.broadcast(some[0].unionByName(some[1]))  # 2 * per_class rows at most
    texts = pick(docs, "doc_id", "text")
    found = texts.join(ids, F.col("doc_id").cast("bigint") == F.col("_doc")).groupBy("_doc", "toxic").agg(F.min("text").alias("text"))
    return stage(found.select("text", "toxic"), "toxicity-sample")


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every word of a folded text with the words beside it."""
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = fold(text).split()
            if words:
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(["", *words[:-1]]), pa.array([*words[1:], ""]), pa.array([toxic] * len(words), pa.int32())], names=["word", "left", "right", "toxic"])


def learn(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Terms that labelled toxic text uses significantly more often.

    A use counts once for each different pair of words beside it, so copies of
    a document add nothing.  Without labels of both classes the lexicon is
    empty and every text scores 0.
    """
    rows = sample(docs, labels, per_class)
    uses = rows.mapInArrow(_uses, "word string, left string, right string, toxic int").distinct()
    n = F.sum(F.col("toxic")).alias("a"), F.sum(1 - F.col("toxic")).alias("b")
    words = stage(uses.groupBy("word").agg(*n), "toxicity-words")
    a_all, b_all = words.agg(F.sum("a"), F.sum("b")).first()
    if not a_all or not b_all:
        return Lexicon({}, exceptions)
    stems = F.filter(F.array(*[F.when(F.length("word") >= k, F.substring("word", 1, k)) for k in STEMS]), lambda s: s.isNotNull())
    terms = F.concat(F.array(F.struct(F.concat(F.lit(" "), "word", F.lit(" ")).alias("term"))), F.transform(stems, lambda s: F.struct(F.concat(F.lit(" "), s).alias("term"))))
    rolled = words.select("a", "b", F.inline(terms)).groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    share = a_all / (a_all + b_all)
    total = F.col("a") + F.col("b")
    part = lambda x, p: F.when(x > 0, x * F.log(x / (total * F.lit(p)))).otherwise(0.0)
    candidates = rolled.count()
    strong = (part(F.col("a"), share) + part(F.col("b"), 1 - share) > math.log(candidates + 1) + EVIDENCE) & (F.col("a") > 4 * share / (1 - share) * (F.col("b") + 0.5))
    found = {r["term"]: (r["a"], r["b"]) for r in rolled.where(strong).collect()}  # bounded by the sample
    weight = {t: math.log((a + 0.5) / (a_all + 1)) - math.log((b + 0.5) / (b_all + 1)) for t, (a, b) in found.items()}
    # A beginning that nearly always goes on in one way says no more than that longer term, which is the safer one.
    longest: dict[str, int] = {}
    for term, (a, _) in found.items():
        for k in range(STEMS.start + 1, len(term)):
            longest[term[:k]] = max(longest.get(term[:k], 0), a)
    clear = {t: w for t, w in weight.items() if longest.get(t, 0) < 0.9 * found[t][0]}
    lexicon = Lexicon(clear, exceptions)
    return calibrated(lexicon, rows)


def calibrated(lexicon: Lexicon, rows: DataFrame) -> Lexicon:
    """Set the threshold at the density that best divides the sample's two classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.density(t) for t in batch.column(0).to_pylist()], pa.float64()), batch.column(1)], names=["density", "toxic"])

    pairs = sorted((r["density"], r["toxic"]) for r in rows.mapInArrow(run, "density double, toxic int").collect())  # bounded by the sample
    positive = [d for d, t in pairs if t and d > 0]
    if not positive:
        return lexicon
    wrong = best = sum(1 for d, t in pairs if not t and d > 0) + sum(1 for d, t in pairs if t and d == 0)
    levels = sorted({d for d, _ in pairs if d > 0})
    lower, upper = levels[0] / 16, levels[0]
    at = {d: [0, 0] for d in levels}
    for d, t in pairs:
        if d > 0:
            at[d][t] += 1
    for i, d in enumerate(levels[:-1]):  # texts up to d would count as clean
        wrong += at[d][1] - at[d][0]
        if wrong < best:
            best, lower, upper = wrong, d, levels[i + 1]
    return Lexicon(lexicon.terms, lexicon.exceptions, math.sqrt(lower * upper))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score: the toxicity of every whole text, 0 to 1, 0.7 at the lexicon's threshold.

    Null and empty texts and texts without letters score 0.  Rows that repeat
    are scored alike; other columns are left out and never looked at.
    """
    texts = pick(docs, "doc_id", "text").withColumns({"doc_id": F.col("doc_id").cast("bigint"), "text": F.col("text").cast("string")})
    held = docs.sparkSession.sparkContext.broadcast(lexicon)  # terms from a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = held.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([lex.score(t.as_py()) for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    return texts.mapInArrow(run, "doc_id bigint, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without an id has no label to learn from, so it counts as held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    lexicon = learn(docs, pick(labels, "doc_id", "toxic").where(~held))
    found = score(docs, lexicon)
    return found.select("doc_id", F.coalesce(held, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
