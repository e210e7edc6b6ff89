"""Temperature scaling: grid, bracket refinement on the driver, and its effect."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LABEL_IDS, LABELS, PROBABILITY_EPS, TEMPERATURE_GRID
from ..functions.numeric import argmax_label, softmax
from ..sources.readers import read_object
from ..sources.sinks import save_json
from .evaluate import probability_metrics


def nll_by_temperature(df: DataFrame, label: str, logits: Sequence[str], temperatures: Sequence[float] = TEMPERATURE_GRID) -> DataFrame:
    """temperature, nll: the whole grid in one scan and one aggregation."""
    y = F.coalesce(*[F.when(F.col(label) == x, F.lit(k)) for x, k in LABEL_IDS.items()], F.lit(1))
    rows = df.select(y.alias("y"), *logits, F.explode(F.array(*[F.lit(float(t)) for t in temperatures])).alias("temperature"))
    p = F.get(softmax([F.col(c) for c in logits], F.col("temperature")), F.col("y"))
    return rows.groupBy("temperature").agg(F.round(F.avg(-F.ln(F.greatest(p, F.lit(PROBABILITY_EPS)))), 6).alias("nll"))


def fit_temperature(df: DataFrame, label: str, logits: Sequence[str], low: float = 0.05, high: float = 10.0, rounds: int = 5, points: int = 12) -> dict[str, object]:
    """The temperature of least NLL: each round evaluates a grid between the neighbours of the best point so far, one
    aggregation each. Raises if scaling changed the greatest class, which it can't."""
    import numpy as np

    df = df.select(label, *logits).persist()
    try:
        best = 1.0
        for _ in range(rounds):
            grid = sorted({round(float(t), 6) for t in np.geomspace(low, high, points)} | {best})
            found = {r["temperature"]: r["nll"] for r in nll_by_temperature(df, label, logits, grid).collect()}
            best = min(grid, key=lambda t: (found.get(t, float("inf")), t))
            k = grid.index(best)
            low, high = grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)]
        scaled = apply_temperature(df, logits, best)
        same = scaled.agg(F.count_if(argmax_label([F.col(c) for c in logits]) != argmax_label([F.col(f"bert_prob_{x}") for x in LABELS])).alias("n")).first()[0] == 0
        if not same:
            raise ValueError("the temperature changed the greatest class")
        probs = [f"bert_prob_{x}" for x in LABELS]
        before = probability_metrics(apply_temperature(df, logits, 1.0), label, probs).first()
        after = probability_metrics(scaled, label, probs).first()
        return {"temperature": best, "before": before.asDict(), "after": after.asDict(), "argmax_unchanged": same, "row_count": df.count()}
    finally:
        df.unpersist()


def save_temperature(found: Mapping[str, object], path: str | Path) -> Path:
    """What fit_temperature() found, as a JSON file."""
    return save_json(dict(found), path)


def load_temperature(path: str | Path) -> float:
    """The temperature of such a file; ValueError unless it is positive."""
    value = float(read_object(path).get("temperature") or 0.0)
    if value <= 0:
        raise ValueError(f"{path}: the temperature must be positive")
    return value


def apply_temperature(df: DataFrame, logits: Sequence[str], temperature: float) -> DataFrame:
    """df with the probability columns of the scaled logits."""
    p = softmax([F.col(c) for c in logits], temperature)
    return df.withColumn("_p", p).withColumns({f"bert_prob_{x}": F.col("_p")[k] for k, x in enumerate(LABELS)}).drop("_p")
