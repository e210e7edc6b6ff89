"""Column contracts as explicit schemas, and checks on frames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _s(names: str, kind: T.DataType | None = None) -> list[T.StructField]:
    return [T.StructField(n, kind or T.StringType()) for n in names.split()]


QUERY = T.StructType(_s("query_id group query status"))
FOUND_BY = T.StructType(_s("query_id query_group query"))
CONTENT = T.StructType([*_s("status text title description published_at content_type"), *_s("http_status", T.LongType()), *_s("extraction_method canonical_url source_url")])
CRAWL_RECORD = T.StructType(
    [*_s("canonical_url url domain title snippet published_date_hint first_found_at last_found_at"), *_s("is_blacklisted", T.BooleanType()),
     T.StructField("found_by", T.ArrayType(FOUND_BY)), T.StructField("content", CONTENT)]
)
CRAWL_FILE = T.StructType(
    [T.StructField("meta", T.MapType(T.StringType(), T.StringType())), T.StructField("queries", T.ArrayType(QUERY)), T.StructField("records", T.ArrayType(CRAWL_RECORD))]
)
GOLDEN = T.StructType(_s("text_id text_selected sentiment location"))
GAZETTEER = T.StructType(_s("code parent_code name"))
OPINIONS = T.StructType(_s("id source text"))
RUNTIME_COLUMNS = ("text_id", "text", "source_url", "source_type", "location")
SPLIT_COLUMNS = ("text_id", "sentiment_label", "label_id", "group_id")

EVIDENCE = (
    "array<struct<term:string,label:string,source:string,score:double,weight:double,category:string,reason:string,span:array<int>,"
    "modifiers:array<string>,clause_weight:double,repetition_weight:double,blocked_by:string>>"
)
RULE_COLUMNS = (
    ("rule_contract_version", "string"), ("rule_resource_version", "string"), ("rule_label", "string"), ("rule_score", "double"), ("rule_confidence", "double"),
    ("rule_status", "string"), ("rule_positive_score", "double"), ("rule_negative_score", "double"), ("rule_positive_count", "bigint"), ("rule_negative_count", "bigint"),
    ("rule_hits", "string"), ("rule_neutral_hits", "string"), ("rule_phrase_hits", "string"), ("rule_word_hits", "string"), ("rule_modifier_hits", "string"),
    ("rule_evidence", EVIDENCE), ("rule_explanation", "string"),
)


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df itself; KeyError names the columns that it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def schema_diff(df: DataFrame, expected: Iterable[str]) -> dict[str, object]:
    """Columns that df lacks, that it has besides, and whether names and order agree."""
    want = list(expected)
    return {"missing": [c for c in want if c not in df.columns], "extra": [c for c in df.columns if c not in want], "same_order": df.columns == want}


def check_domain(df: DataFrame, column: str, allowed: Iterable[str]) -> DataFrame:
    """df with column trimmed and in lower case; ValueError names nulls and values outside the domain. One aggregation of
    at most `len(allowed) + 21` values decides."""
    allowed = list(allowed)
    clean = df.withColumn(column, F.lower(F.regexp_replace(column, r"^\s+|\s+$", "")))
    bad = clean.where(F.col(column).isNull() | ~F.col(column).isin(allowed)).select(column).distinct().limit(20).collect()
    if bad:
        raise ValueError(f"{column}: not in {allowed}: {sorted(str(r[0]) for r in bad)}")
    return clean
