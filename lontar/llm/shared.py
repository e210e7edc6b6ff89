"""What the operators of this subpackage share: tables cut from their lineage, words, split and text keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import forget, shared_folder, stored  # noqa: F401


def words_of(text: Column) -> Column:
    """The longest runs of a-z and 0-9 after lower-casing, in order; an empty array for null."""
    flat = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.when(F.length(flat) > 0, F.split(flat, " ")).otherwise(F.array().cast("array<string>"))


def joined_words(text: Column) -> Column:
    """words_of() in one string with single blanks; empty for null."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(""))


def shingles(words: Column, k: int) -> Column:
    """The distinct runs of k neighbouring words, as 64-bit hashes; empty where there are fewer words."""
    n = F.greatest(F.size(words) - (k - 1), F.lit(0))
    # parallel slices, so that the words are split once for each and not once for each run
    runs = F.arrays_zip(*[F.slice(words, j + 1, n).alias(f"w{j}") for j in range(k)])
    return F.array_distinct(F.transform(runs, lambda z: F.xxhash64(*[z[f"w{j}"] for j in range(k)])))


def norm_split(split: Column) -> Column:
    return F.lower(F.regexp_replace(split, r"^\s+|\s+$", ""))


def columns_as(df: DataFrame, **named: str) -> DataFrame:
    """Only the named columns, under the operator's own names: further columns of any name do no harm."""
    return df.select(*[df[source].alias(target) for target, source in named.items()])
