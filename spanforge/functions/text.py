"""Column helpers for spans: find-all with offsets, surroundings, similarity."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks around a match while a text is searched; a text's own marks become spaces.
OPEN, CLOSE = "\u0001", "\u0002"
FOUND = "array<struct<pii_type:string,text:string,start_pos:int,end_pos:int>>"


def searchable(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), OPEN + CLOSE, "  ")


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


NOTHING_FOUND = f"cast(array() as {FOUND})"


def guarded(guard: str, found: str) -> str:
    """SQL for matches that are looked for in rows that pass the guard only."""
    return f"CASE WHEN {guard} THEN {found} ELSE {NOTHING_FOUND} END"


def find_all(text: str, pattern: str, kind: str) -> str:
    """SQL for the matches of a regular expression in a column, from left to right, with offsets in characters.

    One replacement marks the matches and one pass over the parts between marks adds up the offsets.
    (SQL text, since a thousand nested column calls take seconds to build.)
    """
    match = f"substring_index(part, '{CLOSE}', 1)"
    here = f"named_struct('pii_type', {sql_text(kind)}, 'text', {match}, 'start_pos', acc.at, 'end_pos', acc.at + length({match}))"
    first = "named_struct('at', length(part), 'found', acc.found)"
    later = f"named_struct('at', acc.at + length(part) - 1, 'found', concat(acc.found, array({here})))"
    parts = f"split(regexp_replace({text}, {sql_text(pattern)}, '{OPEN}$0{CLOSE}'), '{OPEN}')"
    return f"aggregate({parts}, named_struct('at', -1, 'found', {NOTHING_FOUND}), (acc, part) -> CASE WHEN acc.at < 0 THEN {first} ELSE {later} END, acc -> acc.found)"


def pattern_of(pattern: str, ignore_case: bool) -> str:
    """The pattern in Java's dialect; word characters are those of any script."""
    return f"(?i{'Uu' if chr(92) + 'w' in pattern or not pattern.isascii() else ''}){pattern}" if ignore_case else pattern


def term_pattern(term: str) -> str:
    """A term between word boundaries, in any case."""
    return rf"(?iUu)\b{re.escape(term)}\b"


def around(text: Column, start: Column, end: Column, reach: int) -> Column:
    """The text from `reach` characters before start to `reach` after end."""
    lo = F.greatest(start - reach, F.lit(0))
    return F.substring(text, lo + 1, end + reach - lo)


def context(text: Column, start: Column, end: Column, reach: int = 50) -> Column:
    """The surroundings of a span, with dots where they are cut."""
    before = F.when(start > reach, "...").otherwise("")
    after = F.when(end + reach < F.length(text), "...").otherwise("")
    return F.concat(before, around(text, start, end, reach), after)


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the text holds one of the words."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def by_value(key: Column, values: dict, default: Column | None = None) -> Column:
    """values[key] as a column."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out if default is None else out.otherwise(default)


def words_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def words_jaccard(a: Column, x: Column, b: Column, y: Column) -> Column:
    """1 for texts a and b equal but for case and outer space, else the Jaccard similarity of their words x and y; 1 if neither has any."""
    union = F.size(F.array_union(x, y))
    share = F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(1.0)
    return F.when(F.trim(F.lower(a)) == F.trim(F.lower(b)), 1.0).otherwise(share)


def word_jaccard(a: Column, b: Column) -> Column:
    """words_jaccard of the texts' own words."""
    return words_jaccard(a, words_of(a), b, words_of(b))


def range_iou(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Intersection over union of two half-open ranges; 0 if both are empty."""
    both = F.greatest(F.least(a2, b2) - F.greatest(a1, b1), F.lit(0))
    union = F.greatest(a2 - a1, F.lit(0)) + F.greatest(b2 - b1, F.lit(0)) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def ratio(n: Column, d: Column, otherwise: float = 0.0) -> Column:
    """n / d, or otherwise where d is not above 0."""
    return F.when(d > 0, n / d).otherwise(otherwise)
