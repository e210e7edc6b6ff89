"""Problem 7: splits that keep related records together.

Method: records that agree in a key are bound to the least record of that key, which gives at most one edge for each
record and key however many records share it; Borůvka's contraction (components.py) builds a spanning forest, stored in
the shared folder. Roots are stratified by size band and dealt systematically to the splits; components of a
thousandth of all rows or more, at most a thousand, are first placed where most rows are missing.

Cases: rows with a null id take no part; keys that stand for a missing value bind nothing; of repeated ids each row's
keys count; records without a partner are components of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .components import components
from .shared import stored

KEYS = ("group_id", "normalized_source_url", "base_text_id")
SHARES = (("train", 0.66), ("calibration", 0.17), ("test", 0.17))
# Spellings of a missing key, lower case.
MISSING = ("", "-", "n/a", "unknown")


def key_of(value: Column) -> Column:
    """The form in which keys are compared; null where the value binds nothing."""
    v = F.regexp_replace(value.cast("string"), r"^\s+|\s+$", "")
    rest = F.regexp_replace(F.regexp_extract(v, r"^.*?://(.*)$", 1), r"#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(?:utm_[^=]*|fbclid|gclid)(?:=|$)")))
    address = F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))
    plain = F.substring_index(v, "#", 1)
    out = F.when(v.contains("://"), F.concat(F.lit("://"), address)).otherwise(F.when(plain != "", plain))
    return F.when(~F.lower(v).isin(*MISSING), out)


def bindings(df: DataFrame, id_col: str = "text_id", keys: Sequence[str] = KEYS) -> DataFrame:
    """Edges a, b: each record with the least record of each of its keys."""
    rows = stored(df.where(df[id_col].isNotNull()).select(df[id_col].alias("id"), *[key_of(df[c]).alias(f"k{n}") for n, c in enumerate(keys)]), "keys")
    edges = None
    for n in range(len(keys)):
        own = rows.select("id", F.col(f"k{n}").alias("k")).where("k IS NOT NULL")
        first = own.groupBy("k").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("k", "first")
        e = own.join(first, "k").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
        edges = e if edges is None else edges.unionByName(e)
    return edges


def bound_records(df: DataFrame, id_col: str = "text_id", keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """(labels: node, root of every record bound to another; forest: a, b), both stored."""
    labels, tree = components(bindings(df, id_col, keys), forest=True)
    return stored(labels, "labels"), stored(tree, "forest")


def group_splits(
    df: DataFrame, id_col: str = "text_id", keys: Sequence[str] = KEYS, shares: Sequence[tuple[str, float]] = SHARES, seed: int = 42, buckets: int = 1024,
) -> DataFrame:
    """One row for each id: id, root, split. Shares hold in rows (distinct ids), as near as whole components allow."""
    labels, _ = bound_records(df, id_col, keys)
    ids = df.where(df[id_col].isNotNull()).select(df[id_col].alias("id")).distinct()
    rows = stored(ids.join(labels.toDF("id", "root"), "id", "left").select("id", F.coalesce("root", "id").alias("root")), "rooted")
    sizes = stored(rows.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    big = sizes.where(F.col("n") * 1000 >= max(total, 1)).where("n > 1").orderBy(F.desc("n"), "root").collect()  # at most 1000
    missing = {name: share * total for name, share in shares}
    placed = []
    for r in big:
        name = max(missing, key=lambda s: (missing[s], s))
        missing[name] -= r["n"]
        placed.append((r["root"], name))
    left = sum(max(0.0, m) for m in missing.values()) or 1.0
    bounds, upto = [], 0.0
    for name, _ in shares:
        upto += max(0.0, missing[name]) / left
        bounds.append((name, upto))
    rest = sizes
    spark = df.sparkSession
    fixed = spark.createDataFrame(placed, f"root {sizes.schema['root'].dataType.simpleString()}, split string")
    if placed:
        rest = sizes.join(F.broadcast(fixed.select("root")), "root", "left_anti")
    dealt = _deal(rest, bounds, seed, buckets)
    return rows.join(dealt.unionByName(fixed), "root").select("id", "root", "split")


def _deal(sizes: DataFrame, bounds: Sequence[tuple[str, float]], seed: int, buckets: int) -> DataFrame:
    """Roots numbered within their size band, in an order of hashes, and dealt along a golden-ratio sequence. Numbering
    goes by buckets of the hash, so that no task holds a band."""
    h = F.xxhash64("root", F.lit(seed))
    t = sizes.select("root", F.floor(F.log2("n")).cast("int").alias("band"), h.alias("h")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    counts = t.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("c"))  # bands times buckets, at most 64 k rows
    before = counts.withColumn("before", F.coalesce(F.sum("c").over(W.partitionBy("band").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("c")
    k = F.row_number().over(W.partitionBy("band", "bucket").orderBy("h", "root")) - 1
    t = t.withColumn("k", k).join(F.broadcast(before), ["band", "bucket"])
    u = F.pmod((F.col("before") + F.col("k")) * F.lit(0.6180339887498949) + F.lit(0.5), F.lit(1.0))
    split = F.lit(bounds[-1][0])
    for name, upto in reversed(bounds[:-1]):
        split = F.when(u < upto, F.lit(name)).otherwise(split)
    return t.select("root", split.alias("split"))
