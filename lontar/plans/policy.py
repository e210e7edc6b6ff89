"""A fusion policy frozen to a file, with the model's temperature, and its application to new rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import HIGH_CONFIDENCE, REVIEW, UNCERTAINTY_WEIGHTS
from ..operators.fusion import add_uncertainty, fuse, valid_evidence
from ..operators.lexicon import Rules, score_texts
from ..operators.providers import from_logits
from ..sources.readers import read_object
from ..sources.sinks import save_json


@dataclass(frozen=True)
class Policy:
    """Weights of the uncertainty score, thresholds of the decision, temperature of the model."""

    weights: Mapping[str, float] = field(default_factory=lambda: dict(UNCERTAINTY_WEIGHTS))
    high: float = HIGH_CONFIDENCE
    review: float = REVIEW
    temperature: float = 1.0

    def save(self, path: str | Path) -> Path:
        return save_json(asdict(self), path)

    @classmethod
    def load(cls, path: str | Path) -> Policy:
        """ValueError for a temperature that isn't positive, for missing weights and for thresholds outside 0..1."""
        data = read_object(path)
        out = cls(**{k: v for k, v in data.items() if k in cls.__dataclass_fields__})
        if not float(out.temperature) > 0:
            raise ValueError(f"{path}: the temperature must be positive")
        if set(out.weights) != set(UNCERTAINTY_WEIGHTS) or not (0 <= out.high <= 1 and 0 <= out.review <= 1):
            raise ValueError(f"{path}: not a policy")
        return out

    @classmethod
    def of(cls, row: Mapping[str, float], temperature: float = 1.0) -> Policy:
        """From a row of policy_search()."""
        return cls({k: float(row[k]) for k in UNCERTAINTY_WEIGHTS}, float(row["high"]), float(row["review"]), temperature)


def component_predictions(df: DataFrame, text: str, logits: Sequence[str], policy: Policy, rules: Rules | None = None) -> DataFrame:
    """df with rule and model columns, the model's scaled by the policy's temperature."""
    return from_logits(score_texts(df, text, rules), logits, policy.temperature)


def apply_policy(df: DataFrame, policy: Policy) -> DataFrame:
    """df (rule and model columns) with uncertainty and decision columns under the policy."""
    valid = valid_evidence(F.col("rule_status"), F.col("rule_evidence") if "rule_evidence" in df.columns else None)
    return fuse(add_uncertainty(df, valid, policy.weights), policy.high, policy.review, valid)
