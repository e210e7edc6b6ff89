"""The pN_ queries: each runs its problem's operator, with production parameters, over the whole of its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracles import ORACLES  # noqa: F401

TITLES = ("content_title", "raw_title")
SITE = ("domain", "canonical_url")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of url_discovery.content_text that at least six pages of the site have."""
    from .site_lines import boilerplate_lines

    return boilerplate_lines(_table(spark, sf_dir, "url_discovery")).select("record_id", "line_no")


def p1_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its text freed of the site's repeated lines: record_id, content_text."""
    from .site_lines import without_boilerplate

    return without_boilerplate(_table(spark, sf_dir, "url_discovery")).select("record_id", "content_text")


def p1_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of repeated lines of each site."""
    from .site_lines import boilerplate_blocks

    return boilerplate_blocks(_table(spark, sf_dir, "url_discovery"))


def _overlap(spark: SparkSession, sf_dir: str):
    from .split_overlap import split_overlap

    return split_overlap(_table(spark, sf_dir, "training_dataset"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a training and a held-out record of training_dataset that overlap."""
    from .split_overlap import record_pairs

    pairs = record_pairs(_overlap(spark, sf_dir))
    return pairs.select(F.least("train_id", "held_id").alias("text_id_a"), F.greatest("train_id", "held_id").alias("text_id_b"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per held-out split and source_type, with the coverage by alignment."""
    from .split_overlap import report

    return report(_overlap(spark, sf_dir)).withColumnRenamed("source", "source_type")


def p2_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record that takes part, with the representative of its wording: text_id, rep, split."""
    return _overlap(spark, sf_dir).members.select(F.col("id").alias("text_id"), "rep", "split")


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links between wordings of both sides: rep_a, rep_b, common and total word pairs."""
    return _overlap(spark, sf_dir).links.toDF("rep_a", "rep_b", "common", "total")


def _sample(spark: SparkSession, sf_dir: str):
    from .calibrated_sample import calibrated_sample

    return calibrated_sample(_table(spark, sf_dir, "candidate_labeling_dataset"), _table(spark, sf_dir, "sampling_targets"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets whose cell has fewer records than wanted."""
    return _sample(spark, sf_dir).report.where("gap > 0").select("target_id")


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample: text_id, target_id."""
    return _sample(spark, sf_dir).sample.select(F.col("id").alias("text_id"), "target_id")


def p3_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target the rows that there are, that are wanted, that were drawn, and the gap."""
    s = _sample(spark, sf_dir)
    drawn = s.sample.groupBy("target_id").agg(F.count(F.lit(1)).alias("drawn"))
    return s.report.join(drawn, "target_id", "left").select("target_id", "available", "wanted", F.coalesce("drawn", F.lit(0)).alias("drawn"), "gap")


def p3_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted and expected rows of each value of each category, all margins met at once."""
    from .calibrated_sample import calibrated_margins

    return calibrated_margins(_table(spark, sf_dir, "candidate_labeling_dataset"), _table(spark, sf_dir, "sampling_targets"))[0].select("category", "value", "wanted", "expected")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of url_discovery that hold residue and no content."""
    from .residue import residue_records

    return residue_records(_table(spark, sf_dir, "url_discovery"), "record_id", "content_text", TITLES, SITE)


def _near(spark: SparkSession, sf_dir: str):
    from .near_duplicates import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "candidate_labeling_dataset"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of candidate_labeling_dataset that are small rewrites of each other."""
    from .near_duplicates import expanded

    return expanded(_near(spark, sf_dir)).toDF("text_id_a", "text_id_b")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each record of twelve words or more: text_id, representative of its wording, group, links."""
    from .near_duplicates import groups

    return groups(_near(spark, sf_dir)).toDF("text_id", "rep", "group_id", "n_links")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of url_discovery.content_text outside the main body."""
    from .main_body import frame_lines

    return frame_lines(_table(spark, sf_dir, "url_discovery"), "record_id", "content_text", TITLES, SITE)


def p6_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main body of every record: record_id, main_text."""
    from .main_body import main_bodies

    return main_bodies(_table(spark, sf_dir, "url_discovery"), "record_id", "content_text", TITLES)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of training_dataset bound to others, with the first record of their component."""
    from .group_splits import bound_records

    return bound_records(_table(spark, sf_dir, "training_dataset"))[0].toDF("text_id", "first_text_id")


def p7_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text_id with the first of its component and its split."""
    from .group_splits import group_splits

    return group_splits(_table(spark, sf_dir, "training_dataset")).toDF("text_id", "first_text_id", "split")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k."""
    from .encode_corpus import encoded

    return encoded(_table(spark, sf_dir, "documents"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .leakage import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items of which they hold twelve words in a row."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaked item the documents that give it away and the longest passage in words."""
    from .leakage import leaked_items

    return leaked_items(_leaks(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a character that came out wrong by decoding."""
    from .charset_repair import repaired

    return repaired(_table(spark, sf_dir, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those documents with all that can be restored."""
    from .charset_repair import repaired

    return repaired(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_cleaned, p1_blocks, p2_found, p2_report, p2_members, p2_links, p3_found, p3_sample, p3_cells, p3_margins, p4_found, p5_found, p5_groups, p6_found, p6_bodies,
        p7_found, p7_splits, p8_ids, p9_found, p9_items, p10_found, p10_restored,
    )
}
