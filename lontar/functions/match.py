"""Terms in texts: whole phrases, substrings, first and longest matches."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and digits on either side of which a place name isn't one.
_PLACE = "0-9A-Za-zÀ-ſ"


def _quoted(term: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", term)


def phrase_pattern(phrase: str) -> str:
    """The phrase between characters that are no word characters, by Unicode's classes."""
    return rf"(?U)(?<!\w){_quoted(phrase)}(?!\w)"


def has_phrase(text: Column, phrase: str) -> Column:
    return text.rlike(phrase_pattern(phrase)) if phrase.strip() else F.lit(False)


def count_phrase(text: Column, phrase: str) -> Column:
    return F.regexp_count(text, F.lit(phrase_pattern(phrase)))


def find_terms(text: Column, terms: Sequence[str]) -> Column:
    """Terms that occur as phrases, the shorter first, then by value, each once."""
    ordered = sorted({t for t in terms if t.strip()}, key=lambda t: (len(t), t))
    low = F.lower(text)
    if not ordered:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(has_phrase(low, t.lower()), F.lit(t)) for t in ordered]))


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """Whether any of the terms is a substring, without regard to case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for t in terms:
        if t.strip():
            out = out | low.contains(t.lower())
    return out


def longest_term(text: Column, terms: Sequence[str]) -> Column:
    """The longest term that is a substring, the first of equals, an empty text without one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    ordered = sorted((t.strip() for t in terms if t.strip()), key=len, reverse=True)
    return F.coalesce(*[F.when(low.contains(t.lower()), F.lit(t)) for t in ordered], F.lit(""))


def has_place(text: Column, alias: str) -> Column:
    return F.lower(text).rlike(rf"(?<![{_PLACE}]){_quoted(alias.lower())}(?![{_PLACE}])")


def first_group(text: Column, groups: Mapping[str, Sequence[str]], default: str) -> Column:
    """The name of the first group with a term in the text."""
    return F.coalesce(*[F.when(contains_any(text, terms), F.lit(name)) for name, terms in groups.items()], F.lit(default))


def ladder(rules: Sequence[tuple[Column, object]], default: object) -> Column:
    """The value of the first rule that holds."""
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return F.lit(default) if out is None else out.otherwise(default)


def first_place(sources: Sequence[tuple[str, Column]], terms: Sequence[tuple[str, str, bool]]) -> Column:
    """struct(location, source, match, is_specific): the first term of the order (specific ones first, then the longer),
    looked for in all sources before the terms of whole provinces are; empty texts without a match. terms: alias,
    canonical name, whether specific. Each source is matched once for each kind: a look-ahead finds the longest alias at
    every place, and of those found the first of the order counts."""
    shape = "struct<location:string,source:string,match:string,is_specific:boolean>"
    found = []
    for specific in (True, False):
        own = sorted(((a.lower(), c) for a, c, s in terms if s is specific and a.strip()), key=lambda t: len(t[0]), reverse=True)
        if not own:
            continue
        pattern = F.lit(rf"(?<![{_PLACE}])(?=({'|'.join(_quoted(a) for a, _ in own)})(?![{_PLACE}]))")
        aliases, names = F.lit([a for a, _ in own]), F.lit([c for _, c in own])
        for name, column in sources:
            hits = F.regexp_extract_all(F.lower(column), pattern, F.lit(1))
            at = F.array_min(F.transform(hits, lambda h: F.array_position(aliases, h))).cast("int")
            hit = F.struct(F.element_at(names, at).alias("location"), F.lit(name).alias("source"), F.element_at(aliases, at).alias("match"), F.lit(specific).alias("is_specific"))
            found.append(F.when(at.isNotNull(), hit))
    none = F.struct(F.lit("").alias("location"), F.lit("").alias("source"), F.lit("").alias("match"), F.lit(False).alias("is_specific"))
    return F.coalesce(*found, none).cast(shape)
