"""Uncertainty, decision-level fusion, its policy search and facts; the older ambiguity decision."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import HIGH_CONFIDENCE, HIGH_GRID, LABELS, REVIEW, REVIEW_GRID, RULE_ALPHA, SIMILARITY_BETA, UNCERTAINTY_WEIGHTS, WEIGHT_GRID
from ..functions.numeric import clamp01, number, row_entropy
from ..functions.text import filled
from ..schemas import require_columns


def valid_evidence(status: Column, hits: Column | None = None) -> Column:
    """A detected rule; with hits (array of structs) any status but weak, unknown and none, and a hit with a score."""
    s = F.coalesce(status, F.lit(""))
    if hits is None:
        return s == "detected"
    return ~s.isin("", "weak", "unknown") & F.coalesce(F.exists(hits, lambda h: h["score"] != 0), F.lit(False))


def add_uncertainty(df: DataFrame, valid: Column | None = None, weights: Mapping[str, float] = UNCERTAINTY_WEIGHTS) -> DataFrame:
    """Eight columns from bert_confidence, bert_margin, bert_label, rule_label; a conflict counts with valid evidence."""
    valid = valid_evidence(F.col("rule_status")) if valid is None else valid
    conflict = valid & (F.col("bert_label") != F.col("rule_label"))
    conf, marg = clamp01(F.col("bert_confidence")), clamp01(F.col("bert_margin"))
    probs = [F.col(f"bert_prob_{x}") for x in LABELS if f"bert_prob_{x}" in df.columns]
    given = F.col("bert_entropy") if "bert_entropy" in df.columns else F.lit(None).cast("double")
    conflict = F.coalesce(conflict, F.lit(False))
    score = F.lit(weights["wc"]) * (1 - conf) + F.lit(weights["wm"]) * (1 - marg) + F.lit(weights["wd"]) * conflict.cast("double")
    return df.withColumns({
        "cross_method_conflict": conflict,
        "confidence_uncertainty": F.round(1 - conf, 6),
        "margin_uncertainty": F.round(1 - marg, 6),
        "normalized_entropy": F.round(row_entropy(given, probs) if probs else clamp01(given), 6),
        "routing_uncertainty_score": F.round(score, 6),
        **{f"uncertainty_weight_{k}": F.lit(float(v)) for k, v in weights.items()},
    })


def decide(valid: Column, bert: Column, rule: Column, confidence: Column, uncertainty: Column, high: Column | float = HIGH_CONFIDENCE, review: Column | float = REVIEW) -> Column:
    """struct of the six decision columns."""
    valid = F.coalesce(valid, F.lit(False))
    bert, rule = F.coalesce(bert, F.lit("netral")), F.coalesce(rule, F.lit("netral"))
    conflict = valid & (bert != rule)
    sure = conflict & (number(confidence) >= high)
    action = F.when(~valid, "bert_only").when(bert == rule, "agreement").when(sure, "conflict_both_confident").otherwise("rule_confident")
    reason = (
        F.when(~valid, "rule_evidence_not_valid").when(bert == rule, "labels_agree").when(sure, "both_confident_keep_model").otherwise("valid_rule_over_unsure_model")
    )
    return F.struct(
        action.alias("fusion_action"), reason.alias("fusion_reason"), F.when(action == "rule_confident", rule).otherwise(bert).alias("final_sentiment"),
        conflict.alias("cross_method_conflict_final"), sure.alias("requires_llm"), ((number(uncertainty) >= review) | sure).alias("needs_review"),
    )


def fuse(df: DataFrame, high: float = HIGH_CONFIDENCE, review: float = REVIEW, valid: Column | None = None) -> DataFrame:
    if "routing_uncertainty_score" not in df.columns:
        df = add_uncertainty(df, valid)
    valid = valid_evidence(F.col("rule_status")) if valid is None else valid
    d = decide(valid, F.col("bert_label"), F.col("rule_label"), F.col("bert_confidence"), F.col("routing_uncertainty_score"), high, review)
    return df.withColumn("_d", d).select("*", "_d.*").drop("_d")


def policy_grid(weights: Sequence[Sequence[float]] = WEIGHT_GRID, high: Sequence[float] = HIGH_GRID, review: Sequence[float] = REVIEW_GRID) -> list[tuple]:
    return [(i, *w, h, r) for i, (w, h, r) in enumerate((w, h, r) for w in weights for h in high for r in review)]


def policy_search(df: DataFrame, actual: str, grid: Sequence[tuple] | None = None) -> DataFrame:
    """All policies of the grid with their figures, the best first: each row is read once and evaluated under all
    policies in place, and one aggregation of partial counts follows. The grid is a short literal."""
    grid = policy_grid() if grid is None else grid
    valid = F.coalesce(valid_evidence(F.col("rule_status")), F.lit(False))
    conf, marg = clamp01(F.col("bert_confidence")), clamp01(F.col("bert_margin"))
    conflict = (valid & (F.col("bert_label") != F.col("rule_label"))).cast("double")
    options = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(g, ("policy", "wc", "wm", "wd", "high", "review"), strict=True)]) for g in grid])
    base = df.select(F.col(actual).alias("actual"), F.col("bert_label").alias("bert"), F.col("rule_label").alias("rule"), valid.alias("valid"), F.col("bert_confidence").alias("c"),
                     conf.alias("conf"), marg.alias("marg"), conflict.alias("conflict"), F.explode(options).alias("g")).select("*", "g.*")
    score = F.round(F.col("wc") * (1 - F.col("conf")) + F.col("wm") * (1 - F.col("marg")) + F.col("wd") * F.col("conflict"), 6)
    d = decide(F.col("valid"), F.col("bert"), F.col("rule"), F.col("c"), score, F.col("high"), F.col("review"))
    rows = base.withColumn("d", d).select("policy", "wc", "wm", "wd", "high", "review", "actual", "bert", F.col("d.final_sentiment").alias("final"), F.col("d.needs_review").alias("flag"))
    wrong = F.col("final") != F.col("actual")
    per = []
    for x in LABELS:
        per += [F.count_if((F.col("actual") == x) & (F.col("final") == x)).alias(f"tp_{x}"), F.count_if(F.col("actual") == x).alias(f"sup_{x}"),
                F.count_if((F.col("final") == x) & F.col("actual").isin(*LABELS)).alias(f"pred_{x}")]
    agg = rows.groupBy("policy", "wc", "wm", "wd", "high", "review").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("flag")).alias("flagged"), F.count_if(wrong).alias("errors"), F.count_if(wrong & F.col("flag")).alias("caught"),
        F.count_if(F.col("final") != F.col("bert")).alias("changed_count"), *per,
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    recall = [ratio(F.col(f"tp_{x}"), F.col(f"sup_{x}")) for x in LABELS]
    f1 = [ratio(2 * F.col(f"tp_{x}"), F.col(f"sup_{x}") + F.col(f"pred_{x}")) for x in LABELS]
    return agg.select(
        "policy", "wc", "wm", "wd", "high", "review", F.round(sum(recall[1:], recall[0]) / 3, 4).alias("balanced_accuracy"), F.round(sum(f1[1:], f1[0]) / 3, 4).alias("macro_f1"),
        F.round(F.when(F.col("errors") > 0, F.col("caught") / F.col("errors")).otherwise(1.0), 6).alias("error_capture"), F.round(ratio(F.col("flagged"), F.col("n")), 6).alias("review_rate"), "changed_count",
    ).orderBy(F.desc("balanced_accuracy"), F.desc("macro_f1"), F.desc("error_capture"), "review_rate", "changed_count", F.desc("high"), "review", "policy")


def fusion_facts(df: DataFrame, actual: str | None = None) -> DataFrame:
    """One row of counts and rates of a fused frame."""
    known = F.col("bert_label").isin(*LABELS) & F.col("final_sentiment").isin(*LABELS)
    changed = known & (F.col("bert_label") != F.col("final_sentiment"))
    aggs = [
        F.count(F.lit(1)).alias("total_rows"), F.count_if(known).alias("comparable_rows"), F.count_if(changed).alias("changed_from_model_count"),
        F.count_if(F.col("cross_method_conflict_final")).alias("conflict_count"), F.count_if(F.col("requires_llm")).alias("requires_llm_count"), F.count_if(F.col("needs_review")).alias("needs_review_count"),
    ]
    if actual:
        labeled = known & F.col(actual).isin(*LABELS)
        good = labeled & changed & (F.col("bert_label") != F.col(actual)) & (F.col("final_sentiment") == F.col(actual))
        bad = labeled & changed & (F.col("bert_label") == F.col(actual)) & (F.col("final_sentiment") != F.col(actual))
        aggs += [F.count_if(labeled).alias("labeled_rows"), F.count_if(good).alias("corrected_rows"), F.count_if(bad).alias("worsened_rows")]
    out = df.agg(*aggs)
    rate = F.when(F.col("comparable_rows") > 0, F.round(F.col("changed_from_model_count") / F.col("comparable_rows"), 6)).otherwise(0.0)
    out = out.withColumn("changed_rate", rate)
    return out.withColumn("net_correct_change", F.col("corrected_rows") - F.col("worsened_rows")) if actual else out


def ambiguity(rule_label: Column, rule_confidence: Column, semantic_label: Column, similarity: Column, cluster: Column, alpha: float = RULE_ALPHA, beta: float = SIMILARITY_BETA) -> Column:
    """struct(is_ambiguous, ambiguity_reason, final_label, decision_source) of the older flow."""
    rule, semantic = F.coalesce(filled(rule_label), F.lit("netral")), F.coalesce(filled(semantic_label), F.lit("netral"))
    reasons = F.array_compact(F.array(
        F.when(number(rule_confidence) < alpha, F.lit("low_rule_confidence")), F.when(number(similarity) < beta, F.lit("low_semantic_similarity")),
        F.when(F.coalesce(cluster, F.lit(-1)) == -1, F.lit("cluster_noise")),
        F.when((rule != "netral") & (semantic != "netral") & (rule != semantic), F.lit("rule_semantic_conflict")),
    ))
    unsure = F.size(reasons) > 0
    rule_first = F.when(rule != "netral", rule).otherwise(semantic)
    final = F.when(unsure, rule_first).otherwise(F.when(semantic != "netral", semantic).otherwise(rule))
    source = F.when(unsure, "non_llm_ambiguous").otherwise("automatic")
    return F.struct(unsure.alias("is_ambiguous"), F.array_join(reasons, ", ").alias("ambiguity_reason"), final.alias("final_label"), source.alias("decision_source"))


def with_ambiguity(df: DataFrame, alpha: float = RULE_ALPHA, beta: float = SIMILARITY_BETA) -> DataFrame:
    """df (rule_label, rule_confidence, semantic_label, semantic_similarity, cluster_id) with the columns of ambiguity();
    KeyError names the columns that it lacks."""
    needed = ("rule_label", "rule_confidence", "semantic_label", "semantic_similarity", "cluster_id")
    d = ambiguity(*[F.col(c) for c in needed], alpha, beta)
    return require_columns(df, needed).withColumn("_d", d).select("*", "_d.*").drop("_d")
