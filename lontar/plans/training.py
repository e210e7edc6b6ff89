"""From golden labels and candidate metadata to a training table with group-preserving splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LABEL_IDS
from ..functions.text import base_id, clean_text, filled
from ..functions.urls import normal_url
from ..operators.lookup import recover_metadata
from ..operators.sampling import assign_split, fold_split, group_folds

METADATA = ("source_url", "normalized_source_url", "source_type", "location")


def training_table(golden: DataFrame, metadata: DataFrame, order: Sequence[str] = ("text_id",)) -> DataFrame:
    """Golden rows (text_id, original_text, sentiment_label, label_id) with cleaned text, recovered metadata, and the
    group that a split must keep whole: the normal address, else the base id."""
    rows = golden.withColumns({"base_text_id": base_id(F.trim("text_id")), "processed_text": clean_text(F.col("original_text"))})
    out = recover_metadata(rows, metadata, "text_id", METADATA, order)
    given = filled(F.col("meta_normalized_source_url"))
    url = F.coalesce(given, F.when(filled(F.col("meta_source_url")).isNotNull(), normal_url(F.col("meta_source_url"))))
    out = out.withColumns({"source_url": F.coalesce("meta_source_url", F.lit("")), "normalized_source_url": F.coalesce(url, F.lit("")), "source_type": F.coalesce("meta_source_type", F.lit(""))})
    group = F.coalesce(filled(F.col("normalized_source_url")), F.col("base_text_id"))
    return out.withColumns({"group_id": group, "group_source": F.when(F.col("normalized_source_url") != "", "normalized_source_url").otherwise("base_text_id")}).drop(*[f"meta_{c}" for c in METADATA])


def with_splits(table: DataFrame, folds: int = 6, seed: int = 42) -> DataFrame:
    """split_fold and split by group; groups stay whole."""
    dealt = group_folds(table.where("group_id IS NOT NULL"), "group_id", "label_id", sorted(LABEL_IDS.values()), folds, seed)
    return assign_split(table, dealt.select("group_id", F.col("fold").alias("split_fold"), fold_split(F.col("fold")).alias("split")), "group_id")
