"""Text functions of the line and word rules, all built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may not stand beside a whole word: before it also a full stop.
BEFORE, AFTER = r"(?<![\p{L}\p{N}_.\-])", r"(?![\p{L}\p{N}_\-])"


def glob_regex(glob: str) -> str:
    """An anchored regular expression for a glob: ``*`` and ``?`` stay inside a path segment, ``**`` spans any number of them."""
    out = []
    segments = glob.split("/")
    for i, segment in enumerate(segments):
        last = i == len(segments) - 1
        if segment == "**":
            out.append("(?:.*)" if last else "(?:[^/]+/)*")
            continue
        out.append("".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in segment) + ("" if last else "/"))
    return "^" + "".join(out) + "$"


def in_scope(path: Column, include: list[str], exclude: list[str] = ()) -> Column:
    """Whether some include glob matches and no exclude glob does; no include globs mean everything."""
    any_of = lambda globs: path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))
    keep = any_of(include) if include else F.lit(True)
    return keep & ~any_of(exclude) if exclude else keep


def whole_word(text: Column, phrase: str) -> Column:
    """Whether a phrase stands in a text as whole words, in any case."""
    return F.lower(text).rlike(BEFORE + re.escape(phrase.lower()) + AFTER)


def anywhere(text: Column, phrase: str) -> Column:
    return F.contains(F.lower(text), F.lit(phrase.lower()))


def shape(text: Column, prefix: str, tail: int, documented: list[str] = ()) -> Column:
    """Credential-like words: a prefix at a word boundary and at least ``tail`` letters, digits, ``_`` or ``-``; documented tails are no finding."""
    found = F.regexp_extract_all(text, F.lit(rf"(?<![A-Za-z0-9_\-])({re.escape(prefix)}[A-Za-z0-9_\-]{{{tail},}})"), 1)
    return F.filter(found, lambda x: ~F.substr(x, F.lit(len(prefix) + 1)).isin(list(documented))) if documented else found


#: Characters that a reader can't see: the tag block, bidirectional controls, and adjacent variation selectors that differ.
#: A flag is a black flag followed by tags and the cancel tag.  Fixed values.
FLAG = r"\x{1F3F4}[\x{E0020}-\x{E007E}]+\x{E007F}"
TAGS = r"[\x{E0000}-\x{E007F}]"
BIDI = r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]"
SELECTORS = r"(?<sel>[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}])(?!\k<sel>)[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]"


def hidden(text: Column) -> Column:
    """Which kind of hidden characters a text holds: ``tag``, ``bidi``, ``selector`` or null."""
    plain = F.regexp_replace(text, FLAG, "")
    return F.when(plain.rlike(TAGS), "tag").when(plain.rlike(BIDI), "bidi").when(plain.rlike(SELECTORS), "selector")


def words_of(text: Column) -> Column:
    """The words of prose or identifiers: split at case turns and anything but letters and digits, lower case, a plural s dropped."""
    spread = F.regexp_replace(F.regexp_replace(text, r"(\p{Ll}|\p{N})(\p{Lu})", "$1 $2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    parts = F.filter(F.split(F.lower(spread), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(parts, singular)


def singular(word: Column) -> Column:
    """Without a plural s: of words longer than three letters that don't end in a double s."""
    return F.regexp_replace(word, r"(?<=^.{3,200})(?<!s)s$", "")


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"(\p{Ll}|\p{N})(\p{Lu})", "$1_$2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1_$2"))


def blank_quotes(line: Column) -> Column:
    """Double-quoted runs, with escapes inside, become one blank."""
    return F.regexp_replace(line, r'"(?:[^"\\]|\\.)*"', " ")


def code_spans(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit("`([^`]+)`"), 1)


def anchor_end(text: Column) -> Column:
    """The last line that an anchor ``path:N``, ``path:N-M`` or ``path:N,M`` names; null without one."""
    numbers = F.regexp_extract(text, r":(\d{1,9}(?:[-,]\d{1,9})*)$", 1)
    return F.when(numbers != "", F.array_max(F.transform(F.split(numbers, "[-,]"), lambda x: x.cast("int"))))


def placeholders(text: Column) -> Column:
    """Names and positions inside format braces; doubled braces are literal."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\{\{", ""), r"\}\}", "")
    return F.regexp_extract_all(plain, F.lit(r"\{([^{}:]*)(?::[^{}]*)?\}"), 1)


def normalised(text: Column, kind: str, token: str, least: int = 1, literal: str = "") -> Column:
    """Runs of at least ``least`` hex digits or digits, or a literal text, replaced by a token."""
    if kind == "text":
        return F.replace(text, F.lit(literal), F.lit(token))
    digits = {"hex": "0-9a-fA-F", "digits": "0-9"}[kind]
    return F.regexp_replace(text, f"[{digits}]{{{least},}}", token.replace("\\", "\\\\").replace("$", "\\$"))


def strip_colour(text: Column) -> Column:
    """Without terminal colour codes."""
    return F.regexp_replace(text, "\x1b\\[[0-9;?]*[ -/]*[@-~]", "")


def version(text: Column) -> Column:
    """A dotted version as an array that compares in numeric order; a part that is no number counts as none."""
    return F.transform(F.split(text, r"\."), lambda x: x.try_cast("int"))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def folded_path(path: Column) -> Column:
    """A relative path without ``.`` and ``..`` segments; null if it climbs out of the tree."""
    start = F.array().cast("array<string>")

    def step(held: Column, part: Column) -> Column:
        up = F.when(F.size(held) > 0, F.slice(held, 1, F.size(held) - 1)).otherwise(F.lit(None).cast("array<string>"))
        return F.when(held.isNull(), held).when(part.isin("", "."), held).when(part == "..", up).otherwise(F.concat(held, F.array(part)))

    return F.aggregate(F.split(path, "/"), start, step, lambda held: F.array_join(held, "/"))


def ago(seconds: Column) -> Column:
    """``N seconds/minutes/hours/days ago`` by the largest whole unit."""
    say = lambda n, unit: F.concat(n.cast("bigint").cast("string"), F.lit(f" {unit}"), F.when(n.cast("bigint") == 1, "").otherwise("s"), F.lit(" ago"))
    return F.when(seconds < 60, say(seconds, "second")).when(seconds < 3600, say(F.floor(seconds / 60), "minute")).when(seconds < 86400, say(F.floor(seconds / 3600), "hour")).otherwise(say(F.floor(seconds / 86400), "day"))
