"""Problem 5: records that are small rewrites of each other.

Method: pigeonhole blocks on the set of three-word runs (pigeonhole.py), Hamming distance verified on sketch and set.
A 64-bit SimHash can't serve here: at a similarity of 0.6 about a quarter of its bits differ, and blocks small enough
to stay equal would hold nearly all records. Copies of one wording are joined first and take part once.

Cases: rows with a null id are left out; of rows with the same id the least text counts; null, empty and short texts
have no partners; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .pigeonhole import HOT, block_pairs, verified
from .shared import columns_as, forget, joined_words, shingles, stored


@dataclass(frozen=True)
class NearDuplicates:
    """links: a, b, common, total between representatives (a < b); members: id, rep - each record of enough words with
    the representative of its wording, the least id that has it."""

    links: DataFrame
    members: DataFrame


def wordings(df: DataFrame, id_col: str, text_col: str, min_words: int, extra: dict[str, str] | None = None) -> DataFrame:
    """id, text (words with single blanks) of the records with min_words or more, each id once; extra: further columns."""
    own = columns_as(df, id=id_col, raw=text_col, **(extra or {})).where("id IS NOT NULL").withColumn("text", joined_words(F.col("raw")))
    once = own.groupBy("id").agg(F.min(F.struct("text", *(extra or {}))).alias("s")).select("id", "s.*")
    return once.where((F.length("text") > 0) & (F.size(F.split("text", " ")) >= min_words))


def near_duplicates(df: DataFrame, id_col: str = "text_id", text_col: str = "text", min_words: int = 12, run: int = 3, permille: int = 600, hot: int = HOT) -> NearDuplicates:
    own = stored(wordings(df, id_col, text_col, min_words).withColumn("key", F.md5("text")), "wordings")
    classes = own.groupBy("key").agg(F.min("id").alias("rep"), F.min("text").alias("text"))
    reps = stored(classes.select("key", F.col("rep").alias("id"), shingles(F.split("text", " "), run).alias("items")), "classes")
    sets = reps.select("id", "items")
    pairs = block_pairs(sets, permille, hot=hot)
    links = stored(verified(pairs, sets, permille), "links")
    forget(pairs)
    members = own.select("id", "key").join(reps.select("key", F.col("id").alias("rep")), "key").select("id", "rep")
    out = NearDuplicates(links, stored(members, "members"))
    forget(own)
    forget(reps)
    return out


#: Copies of one wording up to which pairs of all of them are listed.
COPIES = 1000


def thinned(members: DataFrame, by: list[str], copies: int) -> DataFrame:
    """members with `few`: whether the record stands in pairs with all partners - every record of a wording with up to
    `copies` records, of a larger one the first."""
    n = members.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    return members.join(n, by).select("id", *by, ((F.col("n") <= copies) | (F.col("id") == F.col("first"))).alias("few"))


def expanded(result: NearDuplicates, copies: int = COPIES) -> DataFrame:
    """Pairs a < b of records. Wordings of up to `copies` records are expanded into all pairs; each record of a larger one
    is paired with the first of its own and of each linked wording, so that every record that has a partner comes out
    and the result stays linear in the copies; groups() has the whole membership."""
    m = stored(thinned(result.members, ["rep"], copies), "members")
    twice = m.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rep")
    links = result.links.select("a", "b").unionByName(twice.select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    x = m.select(F.col("id").alias("x"), F.col("rep").alias("a"), F.col("few").alias("few_x"))
    y = m.select(F.col("id").alias("y"), F.col("rep").alias("b"), F.col("few").alias("few_y"))
    most = links.join(x.where("few_x"), "a").join(y.where("few_y"), "b").select("x", "y")
    # a large wording's first record is the least of its class: the representative itself
    rest = links.join(x.where("NOT few_x"), "a").select("x", F.col("b").alias("y")).unionByName(links.join(y.where("NOT few_y"), "b").select(F.col("a").alias("x"), "y"))
    return most.unionByName(rest).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def groups(result: NearDuplicates) -> DataFrame:
    """One row for each record: id, rep, group_id (least id of all that hang together by links), n_links (of its wording)."""
    labels, _ = components(result.links.select("a", "b"))
    n = result.links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    with_root = result.members.join(labels.toDF("rep", "root"), "rep", "left").join(n, "rep", "left")
    return with_root.select("id", "rep", F.coalesce("root", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
