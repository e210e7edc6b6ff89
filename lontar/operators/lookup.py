"""Lookups: gazetteer levels, two-level metadata recovery, query attributes, exact lists, terms in texts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.match import count_phrase
from ..functions.text import base_id, filled, let
from .relational import keep_first


def gazetteer_levels(gazetteer: DataFrame, province: str | None = None) -> DataFrame:
    """province, regency, district by two joins on the parent's code; with a name, of that province only."""
    g = gazetteer.select("code", "parent_code", "name")
    p = g.where(filled(F.col("parent_code")).isNull()).select(F.col("code").alias("p_code"), F.col("name").alias("province"))
    if province:
        p = p.where(F.lower("province") == province.lower())
    r = g.select(F.col("code").alias("r_code"), F.col("parent_code").alias("p_code"), F.col("name").alias("regency"))
    d = g.select(F.col("code").alias("d_code"), F.col("parent_code").alias("r_code"), F.col("name").alias("district"))
    return p.join(r, "p_code").join(d, "r_code", "left").select("province", "regency", "district")


def place_name(name):
    """Without a leading kind of area, each word with a capital."""
    return F.initcap(F.regexp_replace(F.regexp_replace(name, r"^\s+|\s+$", ""), r"^(?i:kabupaten|kab\.|kota|kecamatan)\s+", ""))


def title_case(name: Column) -> Column:
    """A capital wherever a letter follows none, small letters elsewhere: also after hyphens and marks, unlike initcap."""
    low = F.lower(name)
    pairs = F.arrays_zip(F.split(low, r"(?U)\p{L}+", -1).alias("gap"), F.regexp_extract_all(low, F.lit(r"(?U)(\p{L}+)"), F.lit(1)).alias("run"))
    return F.array_join(F.transform(pairs, lambda z: F.concat(z["gap"], F.coalesce(F.initcap(z["run"]), F.lit("")))), "")


def canonical_place(name: Column) -> Column:
    """The name of a gazetteer entry: without a kind of area in capitals before it, in title case."""
    return title_case(F.regexp_replace(F.regexp_replace(name, r"^\s+|\s+$", ""), r"^(?:KABUPATEN|KOTA|KECAMATAN)\s+", ""))


def place_key(name: Column) -> Column:
    """Letters and digits of the name in lower case, for comparison of spellings."""
    return F.regexp_replace(F.lower(name), r"(?U)[^\p{L}\p{N}]+", "")


def recover_metadata(rows: DataFrame, metadata: DataFrame, id_col: str, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows with the metadata of the same id, else of the same base id, the first by the order, and how it was found."""
    meta = metadata.where(filled(F.col(id_col)).isNotNull()).select(F.trim(id_col).alias("_id"), *columns, *[c for c in order if c not in columns])
    exact = keep_first(meta, ["_id"], order).select("_id", F.struct(*columns).alias("_exact"))
    base = keep_first(meta.withColumn("_base", base_id(F.col("_id"))), ["_base"], order).select("_base", F.struct(*columns).alias("_by_base"))
    both = rows.withColumn("_id", F.trim(id_col)).withColumn("_base", base_id(F.trim(id_col))).join(exact, "_id", "left").join(base, "_base", "left")
    out = both.withColumns({f"meta_{c}": F.coalesce(F.col(f"_exact.{c}"), F.when(F.col("_exact").isNull(), F.col(f"_by_base.{c}"))) for c in columns})
    status = F.when(F.col("_exact").isNotNull(), "matched_by_exact_text_id").when(F.col("_by_base").isNotNull(), "matched_by_base_text_id").otherwise("fallback_to_base_text_id")
    return out.withColumn("metadata_recovery_status", status).drop("_id", "_base", "_exact", "_by_base")


def with_query(records: DataFrame, queries: DataFrame, keys: Sequence[str] = ("source_file", "query_id"), columns: Sequence[str] = ("query_group", "query", "query_status")) -> DataFrame:
    """records with the attributes of their query in the same file; values that the record has go first."""
    q = keep_first(queries, list(keys), [c for c in columns if c in queries.columns]).select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    out = records.join(q, list(keys), "left")
    for c in columns:
        own = filled(F.col(c)) if c in records.columns else F.lit(None).cast("string")
        out = out.withColumn(c, F.coalesce(own, F.col(f"_{c}")))
    return out.drop(*[f"_{c}" for c in columns])


def flag_listed(df: DataFrame, listed: DataFrame, key: str, flag: str) -> DataFrame:
    """df with whether the key is in the list; a null key isn't."""
    marks = listed.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_in", F.lit(True))
    return df.join(marks, key, "left").withColumn(flag, F.coalesce("_in", F.lit(False))).drop("_in")


def term_counts(df: DataFrame, text: str, terms: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """keyword, frequency and document_frequency of phrases over the texts: row-local counts, then one aggregation of
    partial sums. Terms are a dictionary, sent with the plan. Single words are looked up among the words of the text, all
    at once; only a term of several words is searched for, where the text has its characters at all."""
    single = sorted({t for t in terms if re.fullmatch(r"\w+", t)})
    none = F.array().cast("array<struct<keyword:string,n:int>>")

    def counted(words: Column) -> Column:
        return F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("keyword"), F.size(F.filter(words, lambda x: x == w)).alias("n")))

    words = F.filter(F.split(F.col(text), r"(?U)[^\w]+"), lambda w: w.isin(single)) if single else F.array().cast("array<string>")
    several = [F.when(F.col(text).contains(t), F.struct(F.lit(t).alias("keyword"), count_phrase(F.col(text), t).cast("int").alias("n"))) for t in terms if t not in single]
    phrases = F.filter(F.array_compact(F.array(*several)), lambda p: p["n"] > 0) if several else none
    hits = df.select(*by, F.explode(F.concat(let(words, counted), phrases)).alias("p")).select(*by, "p.*")
    return hits.groupBy(*by, "keyword").agg(F.sum("n").alias("frequency"), F.count(F.lit(1)).alias("document_frequency"))


def location_scope(location: Column, specific: Sequence[str], provinces: Sequence[str]) -> Column:
    """specific, province, empty or other, without regard to case and to the kind of area before a name."""
    name = F.lower(place_name(F.coalesce(location, F.lit(""))))
    return (
        F.when(name == "", "empty").when(name.isin([x.lower() for x in specific]), "specific").when(name.isin([x.lower() for x in provinces]), "province").otherwise("other")
    )
