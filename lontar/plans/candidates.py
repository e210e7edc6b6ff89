"""From crawl records to candidate tables: rows, screening, audit, sentence rows and the labelling sample, all lazy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.curation import ResearchConfig, SourceRules, audit_rows, candidate_rows, classify_sources, clear_rows, one_per_url
from ..operators.relational import all_of, ordered_columns, row_ids
from ..operators.sampling import bucket_sample, labeling_ready
from ..operators.spans import sentence_rows


def candidate_frames(
    records: DataFrame, cfg: ResearchConfig, rules: SourceRules, order: Sequence[str] = ("source_file", "source_url"), per_bucket: int = 10,
    record_filters: Sequence[Column] = (), candidate_filters: Sequence[Column] = (), sentences: bool = False,
) -> dict[str, DataFrame]:
    """candidates (numbered by the order), clear and audit by screening, ready for labelling, the labelling sample with text
    last; with sentences, a row for each span of the clear rows."""
    first = one_per_url(records.where(all_of(record_filters)), list(order[:1]))
    rows = row_ids(candidate_rows(first, cfg).where(all_of(candidate_filters)), list(order), "RAW-", 4, "text_id")
    rows = classify_sources(rows, rules)
    clear = clear_rows(rows)
    ready = labeling_ready(clear)
    best = [-F.col("evidence_support_score"), (F.col("location") == "").cast("int"), -F.col("raw_text_length")]
    sample = bucket_sample(ready, "text_id", ["source_type", "aspect"], best, per_bucket)
    out = {"candidates": rows, "clear": clear, "audit": audit_rows(rows), "ready": ready, "sample": ordered_columns(sample, ["text_id", "source_url", "source_type", "aspect", "dataset_tier", "location"], ["text"])}
    if sentences:
        out["sentences"] = sentence_rows(clear)
    return out
