"""Crawl records to candidate rows: source screening, inferred columns, support score; manual rows and record search.

All rules are data: term groups, ladders and weights come from a ResearchConfig that the caller provides.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TRACKING
from ..functions.match import contains_any, find_terms, first_group, first_place, ladder
from ..functions.text import collapse, filled, is_filled, unique_segments
from ..functions.urls import blank_walls, domain, normal_url, path, title_from_url, title_url_text
from .relational import keep_first, next_number


@dataclass(frozen=True)
class ResearchConfig:
    """Terms of a study. places: alias, canonical name, whether specific; ladders: substrings of domain and URL to value."""

    relevant: Sequence[str] = ()
    excluded_domains: Sequence[str] = ()
    social_domains: Sequence[str] = ()
    issue_groups: Mapping[str, Sequence[str]] = field(default_factory=dict)
    topic_groups: Mapping[str, Sequence[str]] = field(default_factory=dict)
    places: Sequence[tuple[str, str, bool]] = ()
    source_types: Sequence[tuple[str, Sequence[str]]] = (
        ("academic_repository", ("repository", "journal", "researchgate", "ac.id")), ("government_official", ("go.id", "pln.co.id")), ("corporate_official", ("company", "corporate")),
    )
    default_aspect: str = "general_shs"

    @classmethod
    def from_json(cls, data: Mapping, places: Sequence[tuple[str, str, bool]] = ()) -> ResearchConfig:
        """From a research configuration; its aliases and locations come before the given places, first one wins."""
        found: dict[str, tuple[str, str, bool]] = {}
        specific = {name.lower() for _, name, s in places if s}
        primary = str(data.get("primary_location", "")).lower()
        pairs = [(a, c) for c, aliases in (data.get("location_aliases") or {}).items() for a in (c, *(aliases if isinstance(aliases, list) else ()))]
        pairs += [(x, x) for x in (*(data.get("locations") or ()), *(data.get("known_entities") or ()))] + [(a, c) for a, c, _ in places]
        for alias, canonical in pairs:
            a = str(alias).strip().lower()
            if a and a not in found:
                c = str(canonical).strip()
                found[a] = (a, c, (c.lower() in specific or a in specific) and c.lower() != primary)
        return cls(
            relevant=data.get("url_required_keywords", ()), excluded_domains=data.get("excluded_domains", ()), social_domains=data.get("social_domains", ()),
            issue_groups=data.get("issue_groups", {}), topic_groups=data.get("topic_groups", {}), places=tuple(found.values()),
        )


@dataclass(frozen=True)
class SourceRules:
    """Screening of sources: exact addresses, commercial domains and path markers, terms of other and of own regions."""

    exact: Sequence[str] = ()
    commercial_domains: Sequence[str] = ()
    commercial_paths: Sequence[str] = ()
    outside_terms: Sequence[str] = ()
    local_terms: Sequence[str] = ()
    tracking: Sequence[str] = TRACKING


def flatten_records(files: DataFrame) -> DataFrame:
    """A row for each record of nested crawl files (columns source_file, queries, records): content and the first finding
    flattened, query attributes looked up in the same file, the finding's own ones going first."""
    r = files.select("source_file", "queries", F.explode("records").alias("r")).withColumn("found", F.get(F.col("r.found_by"), F.lit(0)))
    asked = F.get(F.filter("queries", lambda q: q["query_id"] == F.col("found.query_id")), F.lit(0))
    r = r.withColumn("asked", asked)
    return r.select(
        "source_file", F.coalesce("r.content.canonical_url", "r.canonical_url").alias("canonical_url"), F.coalesce("r.url", "r.content.source_url").alias("url"), "r.domain",
        F.col("r.title").alias("raw_title"), F.col("r.content.title").alias("content_title"), "r.snippet", "r.published_date_hint", "r.first_found_at", "r.last_found_at",
        F.coalesce("r.is_blacklisted", F.lit(False)).alias("is_blacklisted"), F.col("r.content.status").alias("content_status"), F.col("r.content.text").alias("content_text"),
        F.coalesce(F.length("r.content.text"), F.lit(0)).cast("bigint").alias("content_text_length"), F.col("r.content.description").alias("content_description"),
        F.col("r.content.published_at").alias("content_published_at"), "r.content.content_type", "r.content.http_status", "r.content.extraction_method",
        F.col("found.query_id").alias("query_id"), F.coalesce(filled(F.col("found.query_group")), F.col("asked.group")).alias("query_group"),
        F.coalesce(filled(F.col("found.query")), F.col("asked.query")).alias("query"), F.col("asked.status").alias("query_status"),
        F.coalesce(F.size("r.found_by"), F.lit(0)).cast("bigint").alias("found_by_count"),
    )


def one_per_url(records: DataFrame, order: Sequence[str] = ("source_file",)) -> DataFrame:
    """The first record of each canonical URL; records without one all stay."""
    has = F.coalesce(filled(F.col("canonical_url")).isNotNull(), F.lit(False))
    first = keep_first(records.where(has), ["canonical_url"], list(order))
    return first.unionByName(records.where(~has))


def source_type(host: Column, url: Column, cfg: ResearchConfig) -> Column:
    both = F.concat_ws(" ", F.coalesce(host, F.lit("")), F.coalesce(url, F.lit("")))
    return ladder([(contains_any(both, cfg.social_domains), "social_media"), *[(contains_any(both, terms), name) for name, terms in cfg.source_types]], "online_news")


def support_score(parts: Sequence[tuple[Column, float]]) -> Column:
    """Sum of the weights whose condition holds, at most 1, to two digits."""
    total = F.lit(0.0)
    for condition, weight in parts:
        total = total + F.when(condition, F.lit(weight)).otherwise(0.0)
    return F.round(F.least(total, F.lit(1.0)), 2)


def notes(parts: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The names of the conditions that hold, joined by `; `."""
    hits = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in parts]))
    return F.when(F.size(hits) > 0, F.array_join(hits, "; ")).otherwise(otherwise)


# What a source's type tells of its speaker, of the kind of statement and of its scope, and the words of a wish.
SPEAKERS = {"academic_repository": "researcher", "government_official": "public_official", "corporate_official": "company_representative", "social_media": "public_user"}
WISHES = ("harap", "dambakan", "ingin", "butuh")
ROLES = {"A_candidate_core": ("candidate_analysis_ready", "core_public_opinion"), "B_review_queue": ("review_required_before_core", "contextual_evidence"), "C_holdout_excluded": ("held_out_not_for_sentiment_core", "excluded")}


def speaker_type(source: Column) -> Column:
    return ladder([(source == name, value) for name, value in SPEAKERS.items()], "community_representative")


def subjectivity_type(text: Column, source: Column, tier: Column) -> Column:
    return ladder([
        (tier == "C_holdout_excluded", "contextual_source"), (source == "academic_repository", "researcher_assessment"),
        (source.isin("government_official", "corporate_official"), "institutional_claim"), (contains_any(text, WISHES), "public_expectation"),
    ], "public_experience")


def opinion_scope(source: Column, tier: Column) -> Column:
    return ladder([
        (tier == "C_holdout_excluded", "contextual_reference"), (source == "academic_repository", "researcher_or_author_assessment"),
        (source.isin("government_official", "corporate_official"), "stakeholder_opinion"),
    ], "public_opinion")


def with_roles(df: DataFrame) -> DataFrame:
    """df (text, source_type, dataset_tier) with speaker, kind and scope of the statement, role and inclusion."""
    tier, source = F.col("dataset_tier"), F.coalesce("source_type", F.lit(""))
    return df.withColumns({
        "speaker_type": speaker_type(source), "subjectivity_type": subjectivity_type(F.col("text"), source, tier), "public_opinion_scope": opinion_scope(source, tier),
        "inclusion_status": ladder([(tier == name, status) for name, (status, _) in ROLES.items()], None), "corpus_role": ladder([(tier == name, role) for name, (_, role) in ROLES.items()], None),
    })


def candidate_rows(records: DataFrame, cfg: ResearchConfig) -> DataFrame:
    """Candidate columns of each record, row-local: merged text, aspect, location, source type, relevance, support and
    note. Ids are left to row_ids(), which needs a total order."""
    url = F.coalesce(filled(F.col("canonical_url")), filled(F.col("url")), F.lit(""))
    host = F.coalesce("domain", F.lit(""))
    df = records.withColumns({"source_url": url, "_host": host})
    df = df.withColumn("_clean", blank_walls(F.col("content_text"), F.col("source_url")))
    df = df.withColumn("text", unique_segments(F.col("content_title"), F.col("raw_title"), F.col("snippet"), F.col("content_description"), title_from_url(F.col("source_url")), F.col("_clean")))
    where = F.concat_ws(" ", "_host", "source_url")
    df = df.withColumns({
        "is_success": F.coalesce(F.col("content_status") == "success", F.lit(False)) & is_filled(F.col("content_text")), "is_excluded": contains_any(where, cfg.excluded_domains),
        "is_social": contains_any(where, cfg.social_domains), "is_relevant": contains_any(F.concat_ws(" ", "source_url", "text", F.substring("_clean", 1, 2000)), cfg.relevant),
        "aspect": first_group(F.col("text"), {**cfg.issue_groups, **{k: v for k, v in cfg.topic_groups.items() if k not in cfg.issue_groups}}, cfg.default_aspect),
        "source_type": source_type(F.col("_host"), F.col("source_url"), cfg),
        "_place": first_place([("text", F.col("text")), ("query", F.coalesce("query", F.lit(""))), ("source_url", F.col("source_url"))], cfg.places),
    })
    usable = F.col("is_success") & ~F.col("is_excluded")
    df = df.withColumns({
        "location": F.col("_place.location"), "location_source": F.col("_place.source"), "location_match": F.col("_place.match"), "is_specific_location": F.col("_place.is_specific"),
        "dataset_tier": ladder([(~usable, "C_holdout_excluded"), (F.col("is_relevant") & ~F.col("is_social"), "A_candidate_core")], "B_review_queue"),
        "evidence_support_score": support_score([(F.col("is_success"), 0.35), (F.col("is_relevant"), 0.25), (F.col("_place.location") != "", 0.2), (F.length("text") >= 80, 0.1), (~F.col("is_social") & ~F.col("is_excluded"), 0.1)]),
        "decision_note": notes([(~F.col("is_success"), "content_not_success"), (~F.col("is_relevant"), "keyword_relevance_needs_review"), (F.col("is_social"), "social_domain_review"), (F.col("is_excluded"), "excluded_domain")], "candidate_from_raw_discovery"),
        "raw_text_length": F.coalesce("content_text_length", F.lit(0)),
        "sentiment_label": F.lit(""), "label_status": F.lit("unlabeled"), "verification_status": F.lit("perlu_verifikasi"), "parent_text_id": F.lit(""),
    }).drop("_host", "_clean", "_place")
    return with_roles(df)


def classify_sources(df: DataFrame, rules: SourceRules, url: str = "source_url", title: str = "raw_title") -> DataFrame:
    """df with normalized_source_url, blacklist_status, blacklist_reason_codes (array) and blacklist_is_excluded."""
    from .lookup import flag_listed

    df = df.withColumn("normalized_source_url", normal_url(F.coalesce(url, F.lit("")), rules.tracking))
    spark = df.sparkSession
    if rules.exact:
        listed = spark.createDataFrame([(u,) for u in rules.exact], "u string").select(normal_url(F.col("u"), rules.tracking).alias("normalized_source_url"))
        df = flag_listed(df, F.broadcast(listed.distinct()) if len(rules.exact) <= 100_000 else listed.distinct(), "normalized_source_url", "_exact")
    else:
        df = df.withColumn("_exact", F.lit(False))
    words = title_url_text(F.col(title), F.col(url))
    route = collapse(F.lower(F.coalesce(path(F.col(url)), F.lit(""))))
    sells = domain(F.coalesce(url, F.lit(""))).isin(list(rules.commercial_domains)) if rules.commercial_domains else F.lit(False)
    for marker in rules.commercial_paths:
        sells = sells | route.contains(marker.lower())
    away = (F.size(find_terms(words, rules.outside_terms)) > 0) & (F.size(find_terms(words, rules.local_terms)) == 0)
    codes = F.array_compact(F.array(F.when(sells, F.lit("commercial_self_promotion")), F.when(away, F.lit("explicit_outside_location_in_url_or_title"))))
    reasons = F.when(F.col("_exact"), F.array(F.lit("exact_url_match"))).otherwise(codes)
    df = df.withColumn("blacklist_reason_codes", reasons)
    status = F.when(F.col("_exact"), "original_exact_blacklist").when(F.size("blacklist_reason_codes") > 0, "discovered_pattern_blacklist").otherwise("clear")
    return df.withColumn("blacklist_status", status).withColumn("blacklist_is_excluded", F.col("blacklist_status") != "clear").drop("_exact")


def clear_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("blacklist_status") == "clear")


def audit_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("blacklist_status") != "clear")


def append_manual(df: DataFrame, row: Mapping[str, object], rules: SourceRules, prefix: str = "MANUAL") -> DataFrame:
    """df with one more row, numbered after the greatest id of the prefix; ValueError for a text that is missing, for a
    source that screening excludes, and for an address or text that df has."""
    spark = df.sparkSession
    if not str(row.get("text") or "").strip():
        raise ValueError("a manual row needs a text")
    n = next_number(df, "text_id", prefix).first()[0]
    full = {c: row.get(c) for c in df.columns} | {"text_id": f"{prefix}-{n:04d}"}
    new = spark.createDataFrame([tuple(full[c] for c in df.columns)], df.schema)
    if "source_url" in df.columns:
        probe = classify_sources(new if "raw_title" in df.columns else new.withColumn("raw_title", F.lit("")), rules)
        if probe.where("blacklist_is_excluded").count():
            raise ValueError("the source is excluded")
        same = normal_url(F.coalesce("source_url", F.lit(""))) == normal_url(F.lit(row.get("source_url") or ""))
        same = (same & (F.lit(row.get("source_url") or "") != "")) | (collapse(F.col("text")) == collapse(F.lit(row["text"])))
    else:
        same = collapse(F.col("text")) == collapse(F.lit(row["text"]))
    if df.where(same).limit(1).count():
        raise ValueError("the row is there already")
    return df.unionByName(new)


def search_urls(records: DataFrame, words: str, columns: Sequence[str] = ("canonical_url", "url"), with_blacklisted: bool = False) -> DataFrame:
    """Records with the words in one of their addresses, without regard to case; blacklisted ones only on demand."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(words.lower()), F.lit(False))
    return records.where(hit if with_blacklisted else hit & ~F.coalesce("is_blacklisted", F.lit(False)))
