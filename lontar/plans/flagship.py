"""From runtime rows to decisions in one lazy plan: prepare, rules, model scores, uncertainty, fusion, summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import HIGH_CONFIDENCE, LABELS, REVIEW
from ..functions.text import clean_text, filled
from ..functions.urls import normal_url
from ..operators.fusion import fuse, valid_evidence
from ..operators.lexicon import Rules, score_texts
from ..operators.providers import from_logits
from ..operators.relational import keep_first, ordered_columns
from ..schemas import RULE_COLUMNS, RUNTIME_COLUMNS, require_columns


def prepare(df: DataFrame, order: Sequence[str] = ("text_id",), slang: Mapping[str, str] | None = None, non_standard: Mapping[str, str] | None = None) -> DataFrame:
    """Rows with original_text, processed_text and normalized_source_url, without those whose cleaned text is empty, the
    first by the order of each address and text. One shuffle, by a hash of address and text."""
    require_columns(df, RUNTIME_COLUMNS)
    given = filled(F.col("normalized_source_url")) if "normalized_source_url" in df.columns else F.lit(None).cast("string")
    out = df.withColumns({
        "original_text": F.coalesce("text", F.lit("")), "processed_text": clean_text(F.col("text"), slang, non_standard),
        "normalized_source_url": F.coalesce(given, normal_url(F.coalesce("source_url", F.lit("")))),
    }).where(F.col("processed_text") != "")
    return keep_first(out, ["normalized_source_url", "processed_text"], list(order))


def decide_rows(prepared: DataFrame, logits: Sequence[str], rules: Rules | None = None, temperature: float = 1.0, high: float = HIGH_CONFIDENCE, review: float = REVIEW) -> DataFrame:
    """Rule, model, uncertainty and decision columns; row-local from here on."""
    scored = from_logits(score_texts(prepared, "processed_text", rules), logits, temperature)
    return fuse(scored, high, review, valid_evidence(F.col("rule_status"), F.col("rule_evidence")))


def order_output(df: DataFrame) -> DataFrame:
    """The known columns in their order, further ones after them."""
    model = ["bert_label", "bert_label_id", *[f"bert_logit_{x}" for x in LABELS], *[f"bert_prob_{x}" for x in LABELS], "bert_confidence", "bert_margin", "bert_entropy", "bert_temperature"]
    final = ["final_sentiment", "fusion_action", "fusion_reason", "cross_method_conflict_final", "requires_llm", "needs_review"]
    return ordered_columns(df, [*RUNTIME_COLUMNS, "original_text", "processed_text", "normalized_source_url", *final, *model, *[c for c, _ in RULE_COLUMNS]])


def run_gates(df: DataFrame) -> DataFrame:
    """One row of booleans: every row has a label of the domain, and no weak rule overrode the model."""
    return df.agg(
        (F.count_if(F.col("final_sentiment").isNull() | ~F.col("final_sentiment").isin(*LABELS)) == 0).alias("all_rows_have_valid_label"),
        (F.count_if((F.col("fusion_action") == "rule_confident") & F.col("rule_status").isin("weak", "unknown")) == 0).alias("no_weak_override"),
    )
