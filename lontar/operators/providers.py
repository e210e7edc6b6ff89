"""Where model scores come from: columns, a batch function, or an adjudicator for a few rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LABEL_IDS, LABELS
from ..functions.numeric import argmax_label, entropy, margin, softmax
from ..functions.text import is_filled


def from_logits(df: DataFrame, logits: Sequence[str], temperature: float = 1.0) -> DataFrame:
    """df with the 12 model columns from three logit columns."""
    z = [F.col(c).cast("double") for c in logits]
    df = df.withColumn("_p", softmax(z, temperature))
    p = [F.col("_p")[k] for k in range(len(LABELS))]
    label = argmax_label(p)
    ids = F.create_map(*[F.lit(x) for kv in LABEL_IDS.items() for x in kv])
    out = df.withColumns({
        "bert_label": label, **{f"bert_logit_{x}": z[k] for k, x in enumerate(LABELS)}, **{f"bert_prob_{x}": p[k] for k, x in enumerate(LABELS)},
        "bert_confidence": F.greatest(*p), "bert_margin": margin(p), "bert_entropy": entropy(p), "bert_temperature": F.lit(float(temperature)),
    })
    return out.withColumn("bert_label_id", ids[F.col("bert_label")]).drop("_p")


def from_batches(df: DataFrame, text: str, predict: Callable[[Sequence[str]], Sequence[Sequence[float]]], temperature: float = 1.0, batch_size: int = 16) -> DataFrame:
    """The same from a function that gives three logits for each text of a batch; it is loaded once for each task."""

    @F.pandas_udf("array<double>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            values = []
            for k in range(0, len(texts), batch_size):
                values += [list(map(float, row)) for row in predict([t or "" for t in texts.iloc[k : k + batch_size]])]
            yield pd.Series(values, index=texts.index)

    scored = df.withColumn("_z", run(F.col(text)))
    scored = scored.withColumns({f"_z{k}": F.col("_z")[k] for k in range(len(LABELS))})
    return from_logits(scored, [f"_z{k}" for k in range(len(LABELS))], temperature).drop("_z", *[f"_z{k}" for k in range(len(LABELS))])


def embed_batches(df: DataFrame, text: str, embed: Callable[[Sequence[str]], Sequence[Sequence[float]]], backend: str, column: str = "embedding", batch_size: int = 16) -> DataFrame:
    """df with vectors of length 1, to six digits, from a function that gives one vector for each text of a batch, loaded once
    for each task, and embedding_backend; a text without length has a vector of zeros."""

    @F.pandas_udf("array<double>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        for texts in series:
            values = []
            for k in range(0, len(texts), batch_size):
                v = np.asarray(embed([t or "" for t in texts.iloc[k : k + batch_size]]), dtype=float)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                values += np.round(np.divide(v, norm, out=np.zeros_like(v), where=norm > 0), 6).tolist()
            yield pd.Series(values, index=texts.index)

    return df.withColumn(column, run(F.col(text))).withColumn("embedding_backend", F.lit(backend))


def parse_label(raw: Column) -> tuple[Column, Column]:
    """(first label in the answer or netral, whether there was one)."""
    hit = F.regexp_extract(F.lower(raw), r"\b(positif|negatif|netral)\b", 1)
    return F.when(F.coalesce(hit, F.lit("")) != "", hit).otherwise("netral"), F.coalesce(hit, F.lit("")) != ""


def adjudicate(df: DataFrame, text: str, ask: Callable[[Sequence[str]], Sequence[str]], flag: str = "requires_llm", longest: int = 2000) -> DataFrame:
    """Flagged rows with the answer's label as final_sentiment. Only filled texts of flagged rows reach `ask`, cut to
    `longest` characters as its prompt allows; an answer without a label, and a blank text, make it netral."""

    @F.pandas_udf("string")
    def answer(texts: pd.Series) -> pd.Series:
        wanted = texts.notna()
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        if wanted.any():
            out[wanted] = list(ask(texts[wanted].tolist()))
        return out

    asked = F.col(flag) & is_filled(F.col(text))
    prompted = df.withColumn("_prompt", F.when(asked, F.substring(text, 1, longest)))
    df = prompted.withColumn("llm_raw", answer(F.col("_prompt")))
    label, parsed = parse_label(F.col("llm_raw"))
    return df.withColumns({
        "llm_label": F.when(F.col(flag), label), "final_sentiment": F.when(F.col(flag), label).otherwise(F.col("final_sentiment")),
        "decision_source": F.when(F.col(flag), "llm").otherwise("fusion"), "llm_parsed": F.when(F.col(flag), parsed),
    }).drop("_prompt")
