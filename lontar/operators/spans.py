"""Sentence spans: rough boundaries, short spans merged, long ones split; and the table of child rows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ABBREVIATIONS, SPAN_MAX, SPAN_MIN
from ..functions.text import filled
from ..runtime import ship

_END = re.compile(r"[.!?;]")
# Parts of addresses within 24 characters around a full stop that end no sentence; soft places of a cut.
_ADDRESS = ("www.", "http://", "https://", ".com", ".co.", ".go.", ".id", "@")
_SOFT = (", ", " - ", " — ", " – ", ": ", " ")
_CLOSING = "\"')]}"


def _ends_sentence(text: str, i: int) -> bool:
    nxt = text[i + 1 : i + 2]
    if nxt and not nxt.isspace() and nxt not in _CLOSING:
        return False
    if text[i] != ".":
        return True
    around = f"{text[max(0, i - 24) : i]}.{text[i + 1 : i + 24]}".casefold()
    if any(a in around for a in _ADDRESS):
        return False
    before = text[:i].split()
    return not before or before[-1].casefold().rstrip(".") not in ABBREVIATIONS


def split_spans(text: str | None, shortest: int = SPAN_MIN, longest: int = SPAN_MAX) -> list[str]:
    """Spans of the text with white space collapsed. A limit of 0 or less switches its step off."""
    flat = " ".join((text or "").split())
    if not flat:
        return []
    rough, start = [], 0
    for m in _END.finditer(flat):
        if _ends_sentence(flat, m.start()):
            rough.append(flat[start : m.end()].strip())
            start = m.end()
    rough.append(flat[start:].strip())
    rough = [s for s in rough if s] or [flat]
    merged = rough if shortest <= 0 else _merge(rough, shortest)
    return merged if longest <= 0 else [part for s in merged for part in _cut(s, longest)]


def _merge(spans: list[str], shortest: int) -> list[str]:
    out, held = [], ""
    for s in spans:
        held = f"{held} {s}" if held else s
        if len(held) >= shortest:
            out.append(held)
            held = ""
    if held:
        out[-1:] = [f"{out[-1]} {held}"] if out else [held]
    return out


def _cut(span: str, longest: int) -> list[str]:
    out = []
    least = max(40, int(longest * 0.45))
    while len(span) > longest:
        at = next((k + len(d) for d in _SOFT if (k := span.rfind(d, 0, longest)) >= least), longest)
        out.append(span[:at].strip())
        span = span[at:].strip()
    return [s for s in (*out, span) if s]


def sentence_rows(df: DataFrame, text: str = "text", id_col: str = "text_id", parent: str | None = None, shortest: int = SPAN_MIN, longest: int = SPAN_MAX) -> DataFrame:
    """A row for each span: the row's columns with the span as text, its id `parent#NN`, base_text_id, sentence_index,
    sentence_count, source_text_length, candidate_text_length. Row-local: no shuffle."""

    ship(df.sparkSession)

    @F.pandas_udf("array<string>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_spans(t, shortest, longest))

    base = F.coalesce(filled(F.col(parent)) if parent else F.lit(None).cast("string"), F.col(id_col))
    rows = df.withColumn("_spans", spans(F.col(text))).withColumn("_n", F.size("_spans")).withColumn("_length", F.length(text))
    rows = rows.select("*", F.posexplode("_spans").alias("_at", "_span"))
    return rows.withColumns({
        "base_text_id": base, "sentence_index": F.col("_at") + 1, "sentence_count": F.col("_n"), "source_text_length": F.col("_length"),
    }).withColumns({
        text: F.col("_span"), id_col: F.concat(F.col("base_text_id"), F.lit("#"), F.lpad(F.col("sentence_index").cast("string"), 2, "0")), "candidate_text_length": F.length("_span"),
        "candidate_generation_method": F.lit("sentence_span"),
    }).drop("_spans", "_n", "_length", "_at", "_span")
