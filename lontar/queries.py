"""Queries over the whole test tables, one or more for each operator, with their SQL in oracles.py."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles, tables
from .config import LABELS
from .functions import match, numeric, text, urls
from .operators import calibration, cluster, curation, evaluate, fusion, lookup, profile, providers, relational, sampling, spans, topics
from .operators.lexicon import Rules, evidence_payload, score_texts, word_scores
from .plans import flagship, legacy, policy
from .plans import model_only as model_only_plan
from .schemas import check_domain, require_columns
from .sources import readers, sinks
from .terms import ASPECTS, LOCAL_TERMS, OUTSIDE_TERMS, PHRASES, SOURCE_LIST, WORDS

LOGITS = ["z_negatif", "z_netral", "z_positif"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _logits(key: Column) -> dict[str, Column]:
    """Logits from an id's hash, in place of a model: the same in any engine."""
    return {c: F.conv(F.substring(F.md5(key.cast("string")), 1 + 4 * k, 4), 16, 10).cast("bigint") % 1000 / 250.0 - 2 for k, c in enumerate(LOGITS)}


def _opinions(spark: SparkSession, d: str) -> DataFrame:
    """documents as runtime rows with logits."""
    docs = _t(spark, d, "documents")
    return docs.select("doc_id", F.col("doc_id").cast("string").alias("text_id"), "text", F.coalesce("url", F.lit("")).alias("source_url"), "source_type", "location").withColumns(_logits(F.col("doc_id")))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """training_dataset once for each text_id, with a valid label, word scores and model columns."""
    t = relational.keep_first(_t(spark, d, "training_dataset").select("text_id", "processed_text", "sentiment_label", "split", "group_id", "location"), ["text_id"], ["processed_text", "sentiment_label", "split", "group_id", "location"])
    t = t.withColumn("actual", F.lower(text.strip(F.col("sentiment_label")))).where(F.col("actual").isin(*LABELS))
    t = t.withColumns(_logits(F.col("text_id")))
    t = providers.from_logits(t, LOGITS, 1.3)
    return t.withColumn("_w", word_scores(F.col("processed_text"), WORDS)).select("*", "_w.*").drop("_w")


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(_labelled(spark, d))


def flagship_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Documents normalised, scored by words, fused with model scores: decisions counted."""
    docs = _opinions(spark, d).withColumn("t", F.lower(text.normalize_symbols(text.remove_url(F.coalesce("text", F.lit(""))))))
    rows = providers.from_logits(docs.where("t <> ''"), LOGITS).withColumn("_w", word_scores(F.col("t"), WORDS)).select("*", "_w.*")
    return fusion.fuse(rows).groupBy("final_sentiment", "fusion_action").agg(F.count(F.lit(1)).alias("jumlah"), F.count_if("needs_review").alias("to_review"))


def flagship_full(spark: SparkSession, d: str) -> DataFrame:
    """The whole plan with de-duplication and the full rule engine."""
    rows = flagship.decide_rows(flagship.prepare(_opinions(spark, d), ["doc_id"]), LOGITS)
    return rows.groupBy("final_sentiment", "fusion_action", "rule_status").agg(F.count(F.lit(1)).alias("jumlah"))


def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower(text.normalize_symbols(text.remove_url(F.coalesce("text", F.lit("")))))
    return _t(spark, d, "documents").select("doc_id", F.md5(t).alias("digest"), F.length(t).alias("n_chars"))


def dictionary_replace(spark: SparkSession, d: str) -> DataFrame:
    t = text.replace_words(F.lower(F.coalesce("processed_text", F.lit(""))), {"nih": "ini", "rumah": "hunian", "lampu": "pelita", "tidak": "tak"})
    return _t(spark, d, "training_dataset").select("text_id", F.md5(t).alias("digest")).distinct()


def token_profile(spark: SparkSession, d: str) -> DataFrame:
    tokens = text.tokens(F.coalesce("text", F.lit("")))
    return _t(spark, d, "documents").select("doc_id", F.size(tokens).alias("n_tokens"), F.size(F.array_distinct(tokens)).alias("n_distinct"), text.word_count(F.coalesce("text", F.lit(""))).alias("n_words"))


def token_offsets(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.explode(text.token_spans(F.col("text"))).alias("t")).select("doc_id", "t.*")


def term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d)
    return lookup.term_counts(rows.select("actual", F.lower(F.coalesce("processed_text", F.lit(""))).alias("t")), "t", PHRASES, ["actual"])


def doc_quality(spark: SparkSession, d: str) -> DataFrame:
    return profile.quality(_t(spark, d, "documents"), "text", "source")


def source_distribution(spark: SparkSession, d: str) -> DataFrame:
    return profile.distribution(_t(spark, d, "documents"), "source", "lang")


def column_values(spark: SparkSession, d: str) -> DataFrame:
    return profile.column_values(_t(spark, d, "candidate_labeling_dataset"), ["source_type", "aspect", "dataset_tier"])


def column_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.column_profile(_t(spark, d, "url_discovery"), ["domain", "content_status", "content_title", "extraction_method", "query_id"])


def note_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.list_counts(_t(spark, d, "candidate_labeling_dataset"), "decision_note", ";")


def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return profile.histogram(_t(spark, d, "documents").select(F.length("text").alias("n")), "n", 0, 2000, 20)


def location_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return profile.crosstab(_labelled(spark, d).withColumn("place", F.coalesce(text.filled(F.col("location")), F.lit("(kosong)"))), "place", "actual", LABELS)


def row_gates(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "training_dataset")
    return profile.gates(t, every_row_has_split=F.col("split").isNull(), every_text_filled=~text.is_filled(F.col("processed_text")), every_id_filled=F.col("text_id").isNull())


def dedupe_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return relational.keep_first(_t(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("digest")), ["source", "digest"], ["doc_id"])


def numbered_rows(spark: SparkSession, d: str) -> DataFrame:
    ids = _t(spark, d, "candidate_labeling_dataset").select("text_id").distinct()
    return relational.row_ids(ids, ["text_id"], "RAW-", 4)


def next_source_number(spark: SparkSession, d: str) -> DataFrame:
    return relational.next_number(_t(spark, d, "candidate_labeling_dataset"), "source_id", "RAW-SRC")


def top_locations(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "candidate_labeling_dataset").where(text.is_filled(F.col("location")) & text.is_filled(F.col("aspect")))
    counts = rows.groupBy("aspect", "location").agg(F.count(F.lit(1)).alias("jumlah"))
    return relational.top_n(counts, [F.desc("jumlah"), F.col("location")], 3, ["aspect"])


def majority_location(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "candidate_labeling_dataset").where(text.is_filled(F.col("aspect")))
    return relational.mode_first(rows.withColumn("position", F.regexp_replace("text_id", r"\D", "").cast("bigint")), ["aspect"], "location", "position")


def review_priority(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "candidate_labeling_dataset").select("text_id", "dataset_tier", "evidence_support_score").distinct().where("dataset_tier IS NOT NULL AND evidence_support_score IS NOT NULL")
    return relational.head(rows, 50, [F.col("dataset_tier"), F.desc("evidence_support_score"), F.col("text_id")])


def url_forms(spark: SparkSession, d: str) -> DataFrame:
    u = _t(spark, d, "url_discovery")
    return u.select("record_id", urls.domain(F.col("url")).alias("domain"), urls.netloc(F.col("url")).alias("netloc"), urls.normal_url(F.col("url")).alias("normal"))


def url_exact(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "url_discovery").select("record_id", urls.normalize_url()(F.col("url")).alias("normal"))


def url_titles(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "url_discovery").select("record_id", urls.title_from_url(F.coalesce("canonical_url", F.lit(""))).alias("title"))


def listed_urls(spark: SparkSession, d: str) -> DataFrame:
    u = _t(spark, d, "url_discovery")
    flagged = lookup.flag_listed(u.select("record_id", "canonical_url"), u.where("is_blacklisted").select("canonical_url"), "canonical_url", "is_listed")
    return flagged.groupBy("is_listed").agg(F.count(F.lit(1)).alias("jumlah"))


def unlisted_urls(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "url_discovery").where(relational.not_in(F.col("domain"), SOURCE_LIST)).groupBy("content_status").agg(F.count(F.lit(1)).alias("jumlah"))


def source_screening(spark: SparkSession, d: str) -> DataFrame:
    u = _t(spark, d, "url_discovery").withColumn("source_url", F.coalesce("canonical_url", F.lit("")))
    rules = curation.SourceRules(commercial_domains=SOURCE_LIST, commercial_paths=("/toko/", "promo"), outside_terms=OUTSIDE_TERMS, local_terms=LOCAL_TERMS)
    rows = curation.classify_sources(u, rules)
    return rows.groupBy("blacklist_status", F.array_join("blacklist_reason_codes", ",").alias("reasons")).agg(F.count(F.lit(1)).alias("jumlah"))


def url_search(spark: SparkSession, d: str) -> DataFrame:
    return curation.search_urls(_t(spark, d, "url_discovery"), "Listrik-Surya").select("record_id")


def query_enrichment(spark: SparkSession, d: str) -> DataFrame:
    u = _t(spark, d, "url_discovery").select("record_id", "source_file", "query_id", "query_group", "query", "query_status")
    return lookup.with_query(u, _t(spark, d, "discovery_queries")).select("record_id", "query_group", "query", "query_status")


def first_per_url(spark: SparkSession, d: str) -> DataFrame:
    return curation.one_per_url(_t(spark, d, "url_discovery").select("record_id", "canonical_url", "source_file"), ["record_id"]).select("record_id")


def aspect_inference(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "candidate_labeling_dataset").select("text_id", match.first_group(F.col("text"), ASPECTS, "general_shs").alias("inferred")).distinct()
    return rows.groupBy("inferred").agg(F.count(F.lit(1)).alias("jumlah"))


def _places(spark: SparkSession, d: str) -> list[tuple[str, str, bool]]:
    rows = _t(spark, d, "gazetteer").select("name", "parent_code").distinct().orderBy("name").collect()  # a gazetteer: a dictionary
    return [(r["name"], r["name"], text_filled(r["parent_code"])) for r in rows if text_filled(r["name"])]


def text_filled(value: str | None) -> bool:
    return bool(value and value.strip())


def location_inference(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "candidate_labeling_dataset").select("text_id", "text", "query")
    place = match.first_place([("text", F.coalesce("text", F.lit(""))), ("query", F.coalesce("query", F.lit("")))], _places(spark, d))
    return rows.select("text_id", place.alias("p")).select("text_id", "p.source", F.col("p.is_specific").alias("is_specific"), (F.col("p.match") != "").alias("found")).distinct()


def candidate_building(spark: SparkSession, d: str) -> DataFrame:
    cfg = curation.ResearchConfig(relevant=("surya", "listrik", "panel"), excluded_domains=("toko",), social_domains=("forum",), issue_groups=ASPECTS, places=_places(spark, d))
    rows = curation.candidate_rows(curation.one_per_url(_t(spark, d, "url_discovery"), ["record_id"]), cfg)
    return rows.groupBy("dataset_tier", "source_type", "aspect", "decision_note").agg(F.count(F.lit(1)).alias("jumlah"), F.round(F.avg("evidence_support_score"), 4).alias("mean_support"))


def labeling_ready(spark: SparkSession, d: str) -> DataFrame:
    return sampling.labeling_ready(_t(spark, d, "candidate_labeling_dataset")).groupBy("source_type", "aspect").agg(F.count(F.lit(1)).alias("jumlah"))


def labeling_buckets(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "candidate_labeling_dataset").select("text_id", "source_type", "aspect").distinct()
    return relational.unpivot_filled(rows, ["source_type", "aspect"]).groupBy("kolom", "nilai").agg(F.count(F.lit(1)).alias("jumlah"))


def labeling_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = sampling.labeling_ready(_t(spark, d, "candidate_labeling_dataset")).dropDuplicates(["text_id"])
    order = [-F.coalesce("evidence_support_score", F.lit(0.0)), -F.coalesce("raw_text_length", F.lit(0))]
    return sampling.bucket_sample(rows, "text_id", ["source_type", "aspect"], order, 10).select("text_id", "labeling_bucket_column", "labeling_bucket_value")


def sentence_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "candidate_labeling_dataset").select("text_id", "text", "parent_text_id").dropDuplicates(["text_id"])
    return spans.sentence_rows(rows, parent="text_id").groupBy("sentence_count").agg(F.count(F.lit(1)).alias("jumlah"), F.max("candidate_text_length").alias("longest"))


def lexicon_words(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", word_scores(F.coalesce("text", F.lit("")), WORDS).alias("w")).select("doc_id", "w.*")


def lexicon_full(spark: SparkSession, d: str) -> DataFrame:
    return score_texts(_t(spark, d, "documents").select("doc_id", "text"), "text", Rules.load()).select("doc_id", "rule_label", "rule_score", "rule_status", "rule_hits", "rule_explanation")


def lexicon_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Every hit of the rule engine with its score and what changed it."""
    rows = score_texts(_t(spark, d, "documents").select("doc_id", "text"), "text", Rules.load()).select("doc_id", F.explode("rule_evidence").alias("e"))
    return rows.select("doc_id", "e.term", "e.label", "e.source", "e.score", F.col("e.span")[0].alias("start"), F.array_join("e.modifiers", ",").alias("modifiers"), "e.clause_weight", "e.repetition_weight", "e.blocked_by")


def evidence_payloads(spark: SparkSession, d: str) -> DataFrame:
    """The evidence of each document as JSON: what its hits sum to, read back from the text."""
    rules = Rules.load()
    rows = score_texts(_t(spark, d, "documents").select("doc_id", "text"), "text", rules)
    p = rows.select("doc_id", F.from_json(evidence_payload(rules), "method string, resource_versions map<string,string>, sentiment_hits array<struct<term:string,score:double>>, neutral_hits array<string>").alias("p"))
    return p.select("doc_id", "p.method", F.size("p.sentiment_hits").alias("hits"), F.element_at("p.resource_versions", "words").alias("words_version"))


def keyword_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d).withColumn("p", F.col("text_id"))
    return topics.keyword_rows(topics.class_summaries(rows, "processed_text", "actual", "location", "p")).select("sentiment_label", "rank", "keyword", "source", "category", "frequency", "document_frequency")


def model_only(spark: SparkSession, d: str) -> DataFrame:
    rows = model_only_plan.model_rows(_opinions(spark, d), LOGITS, ["doc_id"])
    return rows.groupBy("model_sentiment").agg(F.count(F.lit(1)).alias("jumlah"), F.round(F.avg("bert_confidence"), 4).alias("confidence"))


def model_gates(spark: SparkSession, d: str) -> DataFrame:
    return model_only_plan.model_gates(model_only_plan.model_rows(_opinions(spark, d), LOGITS, ["doc_id"]))


def split_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The model alone, for each split."""
    rows = _labelled(spark, d).withColumn("part", F.lower(text.strip(F.col("split")))).where("part IN ('train', 'calibration', 'test')")
    return evaluate.overall_metrics(rows, "actual", "bert_label", ["part"])


def policy_applied(spark: SparkSession, d: str) -> DataFrame:
    """Another frozen policy than the default one, applied to labelled rows."""
    p = policy.Policy({"wc": 0.5, "wm": 0.3, "wd": 0.2}, 0.7, 0.5, 1.3)
    return policy.apply_policy(_labelled(spark, d), p).groupBy("fusion_action", "final_sentiment", "needs_review").agg(F.count(F.lit(1)).alias("jumlah"))


def scatter_points(spark: SparkSession, d: str) -> DataFrame:
    rows = fusion.add_uncertainty(_labelled(spark, d))
    return rows.select("text_id", F.round("bert_confidence", 6).alias("confidence"), F.col("routing_uncertainty_score").alias("uncertainty"), F.round("bert_margin", 6).alias("margin"), F.round("bert_entropy", 6).alias("entropy"))


def report_values(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "golden_labels")
    return profile.report_column(t, ["final_sentiment", "bert_label", "sentiment"], LABELS, "(kosong)")[0].groupBy("report_value").agg(F.count(F.lit(1)).alias("jumlah"))


def statement_roles(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "candidate_labeling_dataset").select("text", "source_type", "dataset_tier").where("dataset_tier IS NOT NULL AND text IS NOT NULL")
    return curation.with_roles(c).groupBy("speaker_type", "subjectivity_type", "public_opinion_scope", "inclusion_status", "corpus_role").agg(F.count(F.lit(1)).alias("jumlah"))


def projection(spark: SparkSession, d: str) -> DataFrame:
    return relational.ordered_columns(_t(spark, d, "golden_labels"), ["sentiment", "absent", "text_id"], ["text_selected"])


def screened_rows(spark: SparkSession, d: str) -> DataFrame:
    u = _t(spark, d, "url_discovery").withColumn("source_url", F.coalesce("canonical_url", F.lit("")))
    rules = curation.SourceRules(commercial_domains=SOURCE_LIST, commercial_paths=("/toko/", "promo"), outside_terms=OUTSIDE_TERMS, local_terms=LOCAL_TERMS)
    rows = curation.classify_sources(u, rules)
    parts = [f(rows).agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("jumlah")) for name, f in (("clear", curation.clear_rows), ("audit", curation.audit_rows))]
    return parts[0].unionByName(parts[1])


def filtered_records(spark: SparkSession, d: str) -> DataFrame:
    conditions = [F.col("content_status") == "success", F.col("found_by_count") >= 1, F.length("content_text") > 200]
    return _t(spark, d, "url_discovery").where(relational.all_of(conditions)).select("record_id")


def invalid_labels(spark: SparkSession, d: str) -> DataFrame:
    return relational.values_outside(_t(spark, d, "golden_labels"), "sentiment", LABELS)


def checked_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels trimmed and in lower case, after the check of their domain."""
    t = _t(spark, d, "training_dataset").where(F.lower(text.strip(F.col("sentiment_label"))).isin(*LABELS))
    return check_domain(t, "sentiment_label", LABELS).groupBy("sentiment_label").agg(F.count(F.lit(1)).alias("jumlah"))


def distinct_lines(spark: SparkSession, d: str) -> DataFrame:
    t = text.drop_repeated_lines(F.coalesce("content_text", F.lit("")))
    return _t(spark, d, "url_discovery").select("record_id", F.md5(t).alias("digest"), F.length(t).alias("n_chars"))


def text_previews(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", text.preview(F.coalesce("text", F.lit("")), 60).alias("preview"))


def adjudicated(spark: SparkSession, d: str) -> DataFrame:
    """Rows that the policy sends to an adjudicator, here a fixed function of the prompt's length."""

    def ask(prompts: Sequence[str]) -> list[str]:
        return [("Jawab: POSITIF", "negatif, kiranya", "entah")[len(p) % 3] for p in prompts]

    rows = providers.adjudicate(_fused(spark, d), "processed_text", ask, longest=100)
    return rows.where("requires_llm").select("text_id", "llm_label", "llm_parsed", "final_sentiment", "decision_source")


def location_scopes(spark: SparkSession, d: str) -> DataFrame:
    c, g = _t(spark, d, "candidate_labeling_dataset"), _places(spark, d)
    names = [lookup_name(n) for n, _, specific in g if specific], [lookup_name(n) for n, _, specific in g if not specific]
    return c.groupBy(lookup.location_scope(F.col("location"), *names).alias("scope")).agg(F.count(F.lit(1)).alias("jumlah"))


def lookup_name(name: str) -> str:
    return re.sub(r"^(?i:kabupaten|kab\.|kota|kecamatan)\s+", "", name.strip())


def canonical_places(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("name")
    return _t(spark, d, "gazetteer").select("code", lookup.canonical_place(n).alias("place"), lookup.place_key(n).alias("key"))


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Crawl records with their texts written as CSV, in quotes with line ends in them, and read back."""
    u = _t(spark, d, "url_discovery").where("content_text IS NOT NULL AND content_text <> ''").select("record_id", "content_text", "http_status")
    path = sinks.save(u, f"{tables.shared_folder(spark)}/lontar-csv-{uuid.uuid4().hex[:12]}.csv")
    return readers.read_csv_any(spark, path, u.schema).select("record_id", F.md5("content_text").alias("digest"), "http_status")


def softmax_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = providers.from_logits(_opinions(spark, d), LOGITS, 1.7)
    return rows.select("doc_id", "bert_label", *[F.round(f"bert_prob_{x}", 6).alias(f"p_{x}") for x in LABELS], F.round("bert_margin", 6).alias("margin"), F.round("bert_entropy", 6).alias("entropy"))


def temperature_grid(spark: SparkSession, d: str) -> DataFrame:
    return calibration.nll_by_temperature(_labelled(spark, d), "actual", LOGITS)


def uncertainty_scores(spark: SparkSession, d: str) -> DataFrame:
    return fusion.add_uncertainty(_labelled(spark, d)).select("text_id", "cross_method_conflict", "routing_uncertainty_score", "normalized_entropy")


def fusion_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("text_id", "fusion_action", "final_sentiment", "requires_llm", "needs_review")


def fusion_facts(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fusion_facts(_fused(spark, d), "actual")


def policy_search(spark: SparkSession, d: str) -> DataFrame:
    return fusion.policy_search(_labelled(spark, d), "actual").drop("wc", "wm", "wd")


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(_fused(spark, d), "actual", "final_sentiment")


def label_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.label_metrics(_fused(spark, d), "actual", "final_sentiment")


def component_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.component_metrics(_fused(spark, d), "actual", {"model": "bert_label", "rule": "rule_label", "hybrid": "final_sentiment"})


def metric_deltas(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.metric_deltas(component_metrics(spark, d), "model", "hybrid")


def probability_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.probability_metrics(_labelled(spark, d), "actual", [f"bert_prob_{x}" for x in LABELS])


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.threshold_sweep(_labelled(spark, d), "actual")


def threshold_choice(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.select_threshold(evaluate.threshold_sweep(_labelled(spark, d), "actual"), precision=0.3, coverage=0.01).select("threshold", "is_valid")


def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.class_weights(_labelled(spark, d), "actual")


def rating_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluate.with_rating(_t(spark, d, "lineitem").withColumn("rating", F.col("l_quantity") % 6), "rating", "label")
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("jumlah"))


def topic_keywords(spark: SparkSession, d: str) -> DataFrame:
    return topics.topic_keywords(_labelled(spark, d), "processed_text", "actual")


def topic_summaries(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d).withColumn("p", F.col("text_id"))
    return topics.class_summaries(rows, "processed_text", "actual", "location", "p").select("sentiment_label", "n_documents", "keyword_count", F.array_join("keywords", ",").alias("keywords"))


def vector_neighbours(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "embeddings")
    return cluster.nearest(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding", 3)


def centroid_similarity(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "embeddings").withColumn("cluster_id", F.col("label").cast("int"))
    return cluster.similarity_to_centroid(v, "cluster_id", "embedding").select("vec_id", "semantic_similarity")


def hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = F.posexplode(numeric.md5_embedding(F.col("text"))).alias("place", "value")
    return _t(spark, d, "documents").select("doc_id", v).where("value <> 0")


def leader_clusters(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "embeddings").withColumns({"name": F.col("label").cast("string"), "part": F.col("vec_id") % 64})
    return cluster.leader_clusters(v, "vec_id", "embedding", "name", "part")


def ambiguity_decisions(spark: SparkSession, d: str) -> DataFrame:
    k = F.conv(F.substring(F.md5("text_id"), 20, 4), 16, 10).cast("bigint")
    rows = _labelled(spark, d).withColumns({"semantic_label": F.col("bert_label"), "semantic_similarity": (k % 100) / 100.0, "cluster_id": (k % 7 - 1).cast("int")})
    return fusion.with_ambiguity(rows).select("text_id", "is_ambiguous", "ambiguity_reason", "final_label", "decision_source")


def legacy_flow(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("doc_id", "text", F.concat_ws("-", F.coalesce("source", F.lit("")), F.col("doc_id") % 16).alias("part"))
    return legacy.legacy_decisions(rows, "doc_id", "text", "part").groupBy("final_label", "is_ambiguous").agg(F.count(F.lit(1)).alias("jumlah"))


def group_leakage(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "training_dataset").where(text.is_filled(F.col("group_id")) & F.col("split").isNotNull())
    return relational.shared_groups(t.withColumn("s", F.lower(text.strip(F.col("split")))), "s", "group_id").select("group_id", F.array_join("splits", ",").alias("splits"))


def fold_assignment(spark: SparkSession, d: str) -> DataFrame:
    t = _labelled(spark, d).where(text.is_filled(F.col("group_id")))
    return sampling.group_folds(t, "group_id", "actual", LABELS).groupBy("fold").agg(F.count(F.lit(1)).alias("groups"))


def split_join(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "training_dataset")
    assignment = t.where("split_fold IS NOT NULL").groupBy("text_id").agg(F.min("split_fold").alias("fold"))
    golden = require_columns(_t(spark, d, "golden_labels"), ["text_id"])
    return sampling.assign_split(golden.select("text_id"), assignment, "text_id").groupBy(F.col("fold")).agg(F.count(F.lit(1)).alias("jumlah"))


def metadata_recovery(spark: SparkSession, d: str) -> DataFrame:
    golden = _t(spark, d, "golden_labels").where("text_id IS NOT NULL").select("text_id")
    out = lookup.recover_metadata(golden, _t(spark, d, "training_dataset").select("text_id", "source_url", "source_type"), "text_id", ["source_url", "source_type"], ["text_id", "source_url", "source_type"])
    return out.groupBy("metadata_recovery_status").agg(F.count(F.lit(1)).alias("jumlah"), F.count("meta_source_url").alias("with_url"))


def gazetteer_levels(spark: SparkSession, d: str) -> DataFrame:
    return lookup.gazetteer_levels(_t(spark, d, "gazetteer"))


def location_coverage(spark: SparkSession, d: str) -> DataFrame:
    places = _t(spark, d, "gazetteer").select(F.col("name").alias("location")).distinct()
    return profile.coverage(places, _t(spark, d, "candidate_labeling_dataset"), "location", 5)


def combination_audit(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "candidate_labeling_dataset")
    keys = ["source_type", "aspect"]
    return profile.combination_audit(c.select(*keys).distinct().where("source_type IS NOT NULL AND aspect IS NOT NULL"), c, sampling.labeling_ready(c), keys)


def event_props(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("jumlah"), F.count(F.from_json("props", "map<string,string>")).alias("parsed"), F.round(F.sum("value"), 2).alias("total"))


def orders_first(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return relational.keep_first(o, ["o_custkey", "o_orderstatus"], ["o_orderkey"])


def lineitem_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.distribution(_t(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


def customer_region(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (_t(spark, d, x) for x in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("jumlah"))


QUERIES = {
    f.__name__: f
    for f in (
        flagship_decisions, flagship_full, text_normalize, dictionary_replace, token_profile, token_offsets, term_frequencies, doc_quality, source_distribution, column_values,
        column_profile, note_counts, length_histogram, location_crosstab, row_gates, dedupe_keep_first, numbered_rows, next_source_number, top_locations, majority_location,
        review_priority, url_forms, url_exact, url_titles, listed_urls, unlisted_urls, source_screening, url_search, query_enrichment, first_per_url, aspect_inference,
        location_inference, candidate_building, labeling_ready, labeling_buckets, labeling_sample, sentence_spans, lexicon_words, lexicon_full, softmax_rows, temperature_grid,
        uncertainty_scores, fusion_decisions, fusion_facts, policy_search, confusion_matrix, label_metrics, component_metrics, metric_deltas, probability_metrics,
        threshold_sweep, threshold_choice, class_weights, rating_labels, topic_keywords, topic_summaries, vector_neighbours, centroid_similarity, hashed_vectors,
        leader_clusters, ambiguity_decisions, legacy_flow, lexicon_evidence, evidence_payloads, keyword_rows, model_only, model_gates, split_metrics, policy_applied, scatter_points,
        csv_round_trip, report_values, statement_roles, projection, screened_rows, filtered_records, invalid_labels, checked_labels, distinct_lines, text_previews, adjudicated, location_scopes, canonical_places, group_leakage, fold_assignment, split_join, metadata_recovery, gazetteer_levels, location_coverage,
        combination_audit, event_props, orders_first, lineitem_profile, customer_region,
    )
}

ORACLES = oracles.ORACLES
