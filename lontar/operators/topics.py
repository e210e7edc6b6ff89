"""Keywords of each sentiment class from the lexicon, their suppression and the class summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import LABELS, SAMPLE_DOCS, TOP_KEYWORDS, TOP_LOCATIONS, TOPIC_ORDER
from ..functions.text import collapse
from .lexicon import Rules
from .lookup import term_counts
from .relational import top_n


def is_noise(keyword: str, fragments: Sequence[str] = (), token_fragments: Sequence[str] = ()) -> bool:
    """Keywords that no report should show: platform wording and broken tokens."""
    words = keyword.split()
    return (
        not words
        or any(f in keyword for f in fragments)
        or any(not w.isascii() or len(w) > 24 or "'" in w or w.endswith(("see", "up")) or any(f in w for f in token_fragments) for w in words)
    )


def keyword_dimension(rules: Rules, blacklist: Sequence[str] = (), fragments: Sequence[str] = (), token_fragments: Sequence[str] = ()) -> list[tuple]:
    """(keyword, source, label, category, weight, overridden) of the usable terms; the lexicon wins over a blacklist."""
    banned = {" ".join(b.casefold().split()) for b in blacklist}
    out = []
    for source, entries in (("phrase", rules.phrases), ("word", rules.words)):
        for term, (label, weight, category, _) in entries.items():
            if not is_noise(term, fragments, token_fragments):
                out.append((term, source, label, category, weight, term in banned))
    return out


def keyword_counts(df: DataFrame, text: str, label: str, rules: Rules, **noise) -> DataFrame:
    """keyword, sentiment_label, source, category, weight, blacklist_overridden, frequency, document_frequency of each term
    in the texts of its own class. Counting is row-local with partial sums; the dimension is a dictionary."""
    dim = keyword_dimension(rules, **noise)
    spark = df.sparkSession
    shape = "keyword string, source string, sentiment_label string, category string, weight double, blacklist_overridden boolean"
    terms = sorted({d[0] for d in dim})
    own = df.select(F.lower(collapse(F.coalesce(text, F.lit("")))).alias("_t"), F.col(label).alias("sentiment_label"))
    if not terms:
        return spark.createDataFrame([], shape + ", frequency bigint, document_frequency bigint")
    counts = term_counts(own, "_t", terms, ["sentiment_label"])
    return counts.join(F.broadcast(spark.createDataFrame(dim, shape)), ["keyword", "sentiment_label"])


def topic_keywords(df: DataFrame, text: str, label: str, rules: Rules | None = None, top: int = TOP_KEYWORDS, **noise) -> DataFrame:
    """The first `top` keywords of each class with their rank: phrases before words, then by document frequency,
    frequency, number of words and keyword; a word that a chosen phrase has is left out. The counts are as few as the
    dictionary, so one small window ranks them."""
    counts = keyword_counts(df, text, label, rules or Rules.load(), **noise)
    order = [F.col("source"), F.desc("document_frequency"), F.desc("frequency"), F.size(F.split("keyword", " ")).desc(), F.col("keyword")]
    phrases = top_n(counts.where("source = 'phrase'"), order, top, ["sentiment_label"], "_k")
    chosen = phrases.groupBy(F.col("sentiment_label").alias("_l")).agg(F.array_distinct(F.flatten(F.collect_list(F.split("keyword", " ")))).alias("_used"))
    words = counts.where("source = 'word'").join(F.broadcast(chosen), F.col("sentiment_label") == F.col("_l"), "left")
    words = words.where(~F.coalesce(F.array_contains("_used", F.col("keyword")), F.lit(False))).drop("_l", "_used")
    return top_n(phrases.drop("_k").unionByName(words), order, top, ["sentiment_label"], "rank")


def class_summaries(df: DataFrame, text: str, label: str, location: str, position: str, rules: Rules | None = None, **noise) -> DataFrame:
    """One row for each class, empty classes too: documents, keywords in rank order, most frequent locations (of equals
    the one seen first), and the first documents by position."""
    spark = df.sparkSession
    classes = spark.createDataFrame([(x, k) for k, x in enumerate(TOPIC_ORDER)], "sentiment_label string, class_order int")
    own = df.where(F.col(label).isin(*LABELS)).select(F.col(label).alias("sentiment_label"), F.col(text).alias("t"), F.col(location).alias("l"), F.col(position).alias("p"))
    docs = own.groupBy("sentiment_label").agg(F.count(F.lit(1)).alias("n_documents"))
    detail = F.struct("rank", "keyword", "source", "category", "weight", "blacklist_overridden", "frequency", "document_frequency")
    # at most TOP_KEYWORDS entries for each class
    words = topic_keywords(df, text, label, rules, **noise).groupBy("sentiment_label").agg(F.array_sort(F.collect_list(detail)).alias("keyword_details"))
    words = words.withColumn("keywords", F.transform("keyword_details", lambda x: x["keyword"]))
    places = own.where("l IS NOT NULL AND l <> ''").groupBy("sentiment_label", "l").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("first"))
    w = W.partitionBy("sentiment_label").orderBy(F.desc("n"), "first", "l")
    best = places.withColumn("k", F.row_number().over(w)).where(F.col("k") <= TOP_LOCATIONS)
    best = best.groupBy("sentiment_label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "l", "n"))), lambda x: F.struct(x["l"].alias("location"), x["n"].alias("n"))).alias("top_locations"))
    early = own.withColumn("k", F.row_number().over(W.partitionBy("sentiment_label").orderBy("p"))).where(F.col("k") <= SAMPLE_DOCS)
    early = early.groupBy("sentiment_label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]).alias("representative_docs"))
    out = classes
    for part in (docs, words, best, early):
        out = out.join(part, "sentiment_label", "left")
    return out.select(
        "sentiment_label", "class_order", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce(F.size("keywords"), F.lit(0)).alias("keyword_count"),
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), F.coalesce("keyword_details", F.array().cast(words.schema["keyword_details"].dataType)).alias("keyword_details"),
        "top_locations", "representative_docs",
    )


def keyword_rows(summaries: DataFrame) -> DataFrame:
    """A row for each keyword of class_summaries(): sentiment_label and the keyword's details."""
    return summaries.select("sentiment_label", F.explode("keyword_details").alias("d")).select("sentiment_label", "d.*")


def extraction_metadata(rules: Rules, blacklist: Sequence[str] = ()) -> dict[str, object]:
    """How the keywords came about: method, order of the classes, versions of the rules, terms that the blacklist has too."""
    versions = dict(part.split("=", 1) for part in rules.version.split(";") if "=" in part)
    overlap = blacklist_overlap(rules, blacklist)
    return {"method": "keywords of the lexicon by class", "class_order": list(TOPIC_ORDER), "resource_versions": versions, "blacklist_overlap": overlap, "blacklist_overlap_count": len(overlap)}


def blacklist_overlap(rules: Rules, blacklist: Sequence[str]) -> list[str]:
    return sorted((set(rules.words) | set(rules.phrases)) & {" ".join(b.casefold().split()) for b in blacklist})
