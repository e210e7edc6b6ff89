"""Text functions as Column expressions: cleaning, dictionary replacement, tokens, lengths and previews."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import NEGATIONS, TOKEN


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at both ends; Spark's trim takes blanks only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def nfkc(c: Column) -> Column:
    """Unicode's compatibility form in lower case without regard to script (case folding), white space collapsed. Texts in
    ASCII stay in the JVM; of the others Python sees each batch once."""
    import unicodedata

    @F.pandas_udf("string")
    def fold(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))

    return F.coalesce(fold(F.when(c.rlike("[^\\x00-\\x7f]"), c)), collapse(F.lower(c)))


def is_filled(c: Column) -> Column:
    return F.coalesce(F.length(strip(c)) > 0, F.lit(False))


def filled(c: Column) -> Column:
    """The value without outer white space, null where nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def remove_url(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)(?:https?://|www\.)\S+", " ")


def normalize_symbols(c: Column) -> Column:
    """Control characters and symbols become blanks, repeated marks one mark, white space one blank."""
    kept = F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " "), r"[^0-9A-Za-zÀ-ſ\s.,!?'\-]", " ")
    return collapse(F.regexp_replace(kept, r"([.,!?'\-])\1+", "$1"))


def map_literal(mapping: Mapping[str, str]) -> Column:
    """A dictionary as a literal; of dictionary size, so it travels with the plan."""
    if not mapping:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for k, v in mapping.items() for x in (k.lower(), v)])


def replace_words(c: Column, mapping: Mapping[str, str]) -> Column:
    """Tokens that the dictionary has, in any case, become their form there; all else stays."""
    if not mapping:
        return c
    lookup = map_literal(mapping)

    def replaced(text: Column) -> Column:
        new = F.transform(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)), lambda t: F.coalesce(lookup[F.lower(t)], t))
        return F.array_join(F.zip_with(F.split(text, TOKEN, -1), new, lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")

    return let(c, replaced)


def clean_text(c: Column, slang: Mapping[str, str] | None = None, non_standard: Mapping[str, str] | None = None) -> Column:
    """All cleaning steps in their order; an empty text for null."""
    t = F.lower(normalize_symbols(remove_url(F.coalesce(c, F.lit("")))))
    for mapping in (slang or {}, non_standard or {}, NEGATIONS):
        t = replace_words(t, mapping)
    return collapse(t)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({TOKEN})"), F.lit(1))


def token_spans(c: Column) -> Column:
    """Tokens in lower case with their character offsets and ordinal: array of (text, start, end, index)."""
    low = F.lower(c)
    pairs = F.arrays_zip(F.split(low, TOKEN, -1).alias("gap"), F.regexp_extract_all(low, F.lit(f"({TOKEN})"), F.lit(1)).alias("token"))
    none = F.array().cast("array<struct<text:string,start:int,end:int,index:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["token"])
        item = F.struct(x["token"].alias("text"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.size(acc["out"]).alias("index"))
        return F.struct(F.coalesce(end, start).cast("int").alias("at"), F.when(x["token"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(item))).alias("out"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def word_count(c: Column) -> Column:
    t = collapse(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def preview(c: Column, limit: int = 80) -> Column:
    t = collapse(c)
    return F.when(F.length(t) > limit, F.concat(F.regexp_replace(F.substring(t, 1, limit - 3), r"\s+$", ""), F.lit("..."))).otherwise(t)


def base_id(c: Column) -> Column:
    return F.substring_index(c, "#", 1)


def unique_segments(*segments: Column) -> Column:
    """Non-empty segments with white space collapsed, each once without regard to case, the first form staying, joined."""
    clean = F.filter(F.array(*[collapse(F.coalesce(s, F.lit(""))) for s in segments]), lambda s: s != "")
    none = F.array().cast("array<string>")
    kept = F.aggregate(clean, none, lambda acc, s: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(s)), acc).otherwise(F.concat(acc, F.array(s))))
    return F.array_join(kept, " ")


def drop_repeated_lines(c: Column) -> Column:
    """Non-empty lines, without those that equal the line before."""
    lines = F.filter(F.transform(F.split(c, "\n"), collapse), lambda x: x != "")

    def kept(own: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("string")), own)
        pairs = F.zip_with(own, F.slice(before, F.lit(1), F.size(own)), lambda x, y: F.when(~x.eqNullSafe(y), x))
        return F.array_join(F.array_compact(pairs), "\n")

    return let(lines, kept)


def value_list(c: Column, sep: str = ",") -> Column:
    """The trimmed, non-empty values of a delimited list."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sep), strip), lambda v: v != "")
