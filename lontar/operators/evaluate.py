"""Classification and probability metrics, component comparison, threshold sweep and selection, class weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ECE_BINS, LABEL_IDS, LABELS, MIN_COVERAGE, MIN_PRECISION, PREFERRED_THRESHOLD, PROBABILITY_EPS, THRESHOLD_GRID, WEAK_THRESHOLD
from ..functions.numeric import number


def rating_label(rating: Column) -> Column:
    """4 and above positif, 2 and below negatif, all else netral."""
    r = rating.cast("string").try_cast("double")
    return F.when(r >= 4, "positif").when(r <= 2, "negatif").otherwise("netral")


def with_rating(df: DataFrame, rating: str, column: str = "sentiment_label") -> DataFrame:
    """df with the label of its rating."""
    return df.withColumn(column, rating_label(F.col(rating)))


def _known(c: Column, labels: Sequence[str]) -> Column:
    return F.when(c.isin(*labels), c).otherwise("netral")


def confusion(df: DataFrame, actual: str, predicted: str, labels: Sequence[str] = LABELS) -> DataFrame:
    """actual, predicted, n on the full grid of labels; rows of unknown actual label don't count, unknown predictions count
    as netral."""
    pairs = [(a, p) for a in labels for p in labels]
    rows = df.where(F.col(actual).isin(*labels)).select(F.col(actual).alias("_a"), _known(F.col(predicted), labels).alias("_p"))
    counts = rows.agg(*[F.count_if((F.col("_a") == a) & (F.col("_p") == p)).alias(f"n{k}") for k, (a, p) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"n{k}").alias("n")) for k, (a, p) in enumerate(pairs)])
    return counts.select(F.explode(cells).alias("c")).select("c.*")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _counts(actual: Column, predicted: Column, labels: Sequence[str]) -> list[Column]:
    p = _known(predicted, labels)
    out = [F.count(F.lit(1)).alias("total"), F.count_if(actual == predicted).alias("right")]
    for x in labels:
        out += [F.count_if((actual == x) & (p == x)).alias(f"tp_{x}"), F.count_if(actual == x).alias(f"sup_{x}"), F.count_if((p == x) & actual.isin(*labels)).alias(f"pred_{x}")]
    return out


def _prf(x: str) -> tuple[Column, Column, Column]:
    p, r = _ratio(F.col(f"tp_{x}"), F.col(f"pred_{x}")), _ratio(F.col(f"tp_{x}"), F.col(f"sup_{x}"))
    return p, r, _ratio(2 * F.col(f"tp_{x}"), F.col(f"pred_{x}") + F.col(f"sup_{x}"))


def label_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = (), labels: Sequence[str] = LABELS) -> DataFrame:
    """label, precision, recall, f1, support, to four digits, for each group."""
    c = df.groupBy(*by).agg(*_counts(F.col(actual), F.col(predicted), labels))
    rows = []
    for x in labels:
        p, r, f = _prf(x)
        rows.append(F.struct(F.lit(x).alias("label"), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f, 4).alias("f1"), F.col(f"sup_{x}").alias("support")))
    return c.select(*by, F.explode(F.array(*rows)).alias("m")).select(*by, "m.*")


def overall_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = (), labels: Sequence[str] = LABELS) -> DataFrame:
    """total, accuracy (over all rows), balanced_accuracy and macro_f1 (over all labels), weighted_f1."""
    c = df.groupBy(*by).agg(*_counts(F.col(actual), F.col(predicted), labels))
    parts = [_prf(x) for x in labels]
    support = sum((F.col(f"sup_{x}") for x in labels[1:]), F.col(f"sup_{labels[0]}"))
    n = len(labels)
    weighted = sum((parts[k][2] * F.col(f"sup_{x}") for k, x in enumerate(labels)), F.lit(0.0))
    return c.select(
        *by, "total", F.round(_ratio(F.col("right"), F.col("total")), 4).alias("accuracy"), F.round(sum((p[1] for p in parts), F.lit(0.0)) / n, 4).alias("balanced_accuracy"),
        F.round(sum((p[2] for p in parts), F.lit(0.0)) / n, 4).alias("macro_f1"), F.round(_ratio(weighted, support), 4).alias("weighted_f1"),
    )


def component_metrics(df: DataFrame, actual: str, components: Mapping[str, str]) -> DataFrame:
    """overall_metrics for each of several prediction columns, in one scan."""
    pairs = F.array(*[F.struct(F.lit(name).alias("component"), F.col(column).alias("_predicted")) for name, column in components.items()])
    rows = df.select(F.col(actual).alias("_actual"), F.explode(pairs).alias("c")).select("_actual", "c.*")
    return overall_metrics(rows, "_actual", "_predicted", ["component"])


def metric_deltas(metrics: DataFrame, base: str, other: str, names: Sequence[str] = ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")) -> DataFrame:
    """metric, base, other and their difference for two components."""
    def side(c: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
        return metrics.where(F.col("component") == c).select(F.explode(pairs).alias("m")).select("m.*")

    both = side(base).withColumnRenamed("value", "base").join(side(other).withColumnRenamed("value", "other"), "metric")
    return both.withColumn("delta", F.round(F.col("other") - F.col("base"), 4))


def probability_metrics(df: DataFrame, actual: str, probabilities: Sequence[str], bins: int = ECE_BINS, labels: Sequence[str] = LABELS, by: Sequence[str] = ()) -> DataFrame:
    """nll, multiclass_brier_score, ece to six digits; an unknown actual label counts as netral. Confidence bins are
    aggregated first, so the second aggregation sees at most `bins` rows a group."""
    p = [F.col(c).cast("double") for c in probabilities]
    y = F.coalesce(*[F.when(F.col(actual) == x, F.lit(LABEL_IDS.get(x, k))) for k, x in enumerate(labels)], F.lit(1))
    own = F.coalesce(*[F.when(y == k, v) for k, v in enumerate(p)])
    top = F.greatest(*p)
    guess = F.coalesce(*[F.when(v == top, F.lit(k)) for k, v in enumerate(p)])
    brier = sum(((v - F.when(y == k, 1.0).otherwise(0.0)) * (v - F.when(y == k, 1.0).otherwise(0.0)) for k, v in enumerate(p)), F.lit(0.0))
    rows = df.select(*by, F.least(F.floor(top * bins), F.lit(bins - 1)).alias("_bin"), top.alias("_conf"), (guess == y).cast("double").alias("_hit"), (-F.ln(F.greatest(F.least(own, F.lit(1.0)), F.lit(PROBABILITY_EPS)))).alias("_nll"), brier.alias("_brier"))
    binned = rows.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("n"), F.sum("_conf").alias("conf"), F.sum("_hit").alias("hit"), F.sum("_nll").alias("nll"), F.sum("_brier").alias("brier"))
    n = F.sum("n")
    return binned.groupBy(*by).agg(F.round(F.sum("nll") / n, 6).alias("nll"), F.round(F.sum("brier") / n, 6).alias("multiclass_brier_score"), F.round(F.sum(F.abs(F.col("conf") - F.col("hit"))) / n, 6).alias("ece"))


def threshold_sweep(df: DataFrame, actual: str, thresholds: Sequence[float] = THRESHOLD_GRID) -> DataFrame:
    """Figures of each threshold from rows scored once: rule_label, rule_confidence and whether there is a hit
    (rule_status not unknown)."""
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    rows = df.select(F.col(actual).alias("a"), "rule_label", "rule_confidence", (F.col("rule_status") != "unknown").alias("hit"), F.explode(grid).alias("threshold"))
    fired = F.col("hit") & (F.col("rule_confidence") >= F.col("threshold"))
    right = fired & (F.col("rule_label") == F.col("a"))
    c = rows.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(fired).alias("detected_count"), F.count_if(right).alias("correct_detected_count"),
        F.count_if(F.col("hit") & ~fired).alias("weak_count"), F.count_if(~F.col("hit")).alias("unknown_count"),
    )
    return c.select(
        "threshold", "detected_count", "correct_detected_count", (F.col("detected_count") - F.col("correct_detected_count")).alias("wrong_detected_count"), "weak_count", "unknown_count",
        F.round(_ratio(F.col("correct_detected_count"), F.col("detected_count")), 6).alias("precision_on_detected"), F.round(_ratio(F.col("detected_count"), F.col("n")), 6).alias("coverage"),
    )


def select_threshold(sweep: DataFrame, precision: float = MIN_PRECISION, coverage: float = MIN_COVERAGE, preferred: float | None = PREFERRED_THRESHOLD) -> DataFrame:
    """The preferred threshold if it is valid, else the valid one of greatest coverage; without a valid one the most
    precise. One row."""
    valid = (F.col("precision_on_detected") >= precision) & (F.col("coverage") >= coverage) & (F.col("detected_count") > 0)
    liked = valid & (F.col("threshold") == F.lit(preferred)) if preferred is not None else F.lit(False)
    rank = F.when(liked, 0).when(valid, 1).otherwise(2)
    by_cover = F.when(rank == 2, F.col("precision_on_detected")).otherwise(F.col("coverage"))
    second = F.when(rank == 2, F.col("coverage")).otherwise(F.col("precision_on_detected"))
    return sweep.withColumn("is_valid", valid).withColumn("_r", rank).orderBy("_r", by_cover.desc(), second.desc(), F.desc("threshold")).limit(1).drop("_r")


def class_weights(df: DataFrame, label: str, labels: Sequence[str] = LABELS) -> DataFrame:
    """label, n, weight = rows / (number of labels * max(n, 1)), over the full label grid."""
    c = df.where(F.col(label).isin(*labels)).agg(F.count(F.lit(1)).alias("_t"), *[F.count_if(F.col(label) == x).alias(f"n{k}") for k, x in enumerate(labels)])
    cells = F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"n{k}").alias("n"), F.round(F.col("_t") / (len(labels) * F.greatest(F.col(f"n{k}"), F.lit(1))), 6).alias("weight")) for k, x in enumerate(labels)])
    return c.select(F.explode(cells).alias("c")).select("c.*")


def weak_status(score: Column, hit: Column, threshold: float = WEAK_THRESHOLD, max_abs: float = 3.0) -> Column:
    conf = F.round(F.least(F.abs(number(score)) / max_abs, F.lit(1.0)), 4)
    return F.when(~hit, "unknown").when(conf < threshold, "weak").otherwise("detected")
