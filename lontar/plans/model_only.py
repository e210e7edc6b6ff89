"""Runtime rows with model scores alone: the flagship plan without rules and fusion, and its gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LABELS
from ..functions.text import is_filled
from ..operators.providers import from_logits
from ..operators.relational import ordered_columns
from .flagship import prepare

FIRST = (
    "text_id", "original_text", "processed_text", "bert_label", "model_sentiment", *[f"bert_prob_{x}" for x in LABELS], "bert_confidence", "bert_margin", "bert_entropy", "bert_temperature",
    "source_url", "source_type", "location",
)


def model_rows(df: DataFrame, logits: Sequence[str], order: Sequence[str] = ("text_id",), temperature: float = 1.0) -> DataFrame:
    """Prepared rows with model columns and model_sentiment, in the order of FIRST; further columns follow."""
    rows = from_logits(prepare(df, order), logits, temperature)
    return ordered_columns(rows.withColumn("model_sentiment", F.col("bert_label")), FIRST)


def model_gates(rows: DataFrame) -> DataFrame:
    """One row: rows, and whether each has a sentiment and all sentiments are of the domain."""
    s = F.col("model_sentiment")
    return rows.agg(
        F.count(F.lit(1)).alias("output_rows"), (F.count_if(~is_filled(s)) == 0).alias("all_rows_have_sentiment"), (F.count_if(s.isNotNull() & ~s.isin(*LABELS)) == 0).alias("all_labels_valid"),
    )
