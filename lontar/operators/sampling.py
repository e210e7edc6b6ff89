"""Bucketed sampling with exclusion across buckets, and splits that keep groups whole."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import FOLDS, SEED
from ..functions.text import is_filled
from .relational import unpivot_filled


def labeling_ready(df: DataFrame, tiers: Sequence[str] = ("A_candidate_core", "B_review_queue"), sources: Sequence[str] = ("text", "query")) -> DataFrame:
    """Rows with all that labelling needs: a tier of the list, filled source type, aspect, text and location, and a
    specific location that the text or the query names."""
    ok = F.col("dataset_tier").isin(list(tiers)) & F.col("is_specific_location") & F.col("location_source").isin(list(sources))
    for c in ("source_type", "aspect", "text", "location"):
        ok = ok & is_filled(F.col(c))
    return df.where(ok)


def bucket_sample(df: DataFrame, id_col: str, columns: Sequence[str], order: Sequence[Column], per_bucket: int) -> DataFrame:
    """Up to per_bucket rows for each value of each column, rare values first, no row twice.

    A bucket chooses from rows that earlier buckets left, so it needs at most per_bucket rows for each earlier bucket:
    every bucket's first per_bucket * number of buckets rows, found by a window that keeps a rank's worth of each
    bucket, are enough, and only those keys reach the greedy pass. Buckets are values of category columns.
    """

    kind = df.schema[id_col].dataType.simpleString()
    rows = unpivot_filled(df.select(id_col, *columns, *[o.alias(f"_o{k}") for k, o in enumerate(order)]), columns, "column", "value")
    keys = [F.col(f"_o{k}") for k in range(len(order))]
    sizes = rows.groupBy("column", "value").agg(F.count(F.lit(1)).alias("size"))
    n_buckets = sizes.count()
    w = W.partitionBy("column", "value").orderBy(*keys, id_col)
    near = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_bucket * max(1, n_buckets)).select(id_col, "column", "value", "rank")

    def greedy(f: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for (_, column, value), g in f.sort_values(["size", "column", "value", "rank"]).groupby(["size", "column", "value"], sort=True):
            picked = 0
            for i in g[id_col]:
                if i not in taken:
                    taken.add(i)
                    out.append((i, column, value))
                    picked += 1
                    if picked == per_bucket:
                        break
        return pd.DataFrame(out, columns=[id_col, "labeling_bucket_column", "labeling_bucket_value"])

    chosen = near.join(F.broadcast(sizes), ["column", "value"]).withColumn("all", F.lit(1)).groupBy("all").applyInPandas(greedy, f"{id_col} {kind}, labeling_bucket_column string, labeling_bucket_value string")
    return df.drop("labeling_bucket_column", "labeling_bucket_value").join(chosen, id_col)


#: Groups of one profile that one task ranks, about.
UNIT = 100_000
#: Groups beyond the largest that are dealt one by one, about, so that loads which differ after whole rounds even out.
SINGLY = 20_000


def group_folds(df: DataFrame, group: str, label: str, labels: Sequence, folds: int = FOLDS, seed: int = SEED, largest: int = 20_000) -> DataFrame:
    """group, fold: groups stay whole and labels spread evenly. Label counts of each group are aggregated. The `largest`
    groups are dealt one by one, where they hurt balance most; of the others, all with the same counts are a profile,
    whose groups are dealt round by round in the order of their hash, and the last of them one by one from the loads so
    far. The driver holds the largest groups and the profiles."""
    cs = [f"c{k}" for k in range(len(labels))]
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(label) == x).alias(c) for c, x in zip(cs, labels, strict=True)])
    h = F.xxhash64(group, F.lit(seed))
    ranked = counts.withColumn("h", h)
    rows = ranked.orderBy(F.desc("n"), "h", group).limit(largest).collect()
    spark = df.sparkSession
    kind = df.schema[group].dataType.simpleString()
    units, rest = [], None
    if len(rows) == largest:
        head = spark.createDataFrame([(r[group],) for r in rows], f"_g {kind}")
        rest = ranked.join(F.broadcast(head), F.col(group).eqNullSafe(F.col("_g")), "left_anti")
        # a profile of very many groups is cut by hash, so that no task ranks them all
        sizes = rest.groupBy("n", *cs).agg(F.ceil(F.count(F.lit(1)) / UNIT).alias("parts"))
        rest = rest.join(sizes, ["n", *cs]).withColumn("part", F.pmod("h", "parts"))
        units = rest.groupBy("n", *cs, "part").agg(F.count(F.lit(1)).alias("m")).collect()
        units.sort(key=lambda r: (-r["n"], [r[c] for c in cs], r["part"]))
    total = [max(1, sum(r[c] for r in rows) + sum(r[c] * r["m"] for r in units)) for c in cs]
    load = [[0.0] * len(labels) for _ in range(folds)]
    size = [0] * folds

    def deal(r) -> int:
        def cost(f: int) -> tuple:
            # spread of each label's share over folds if the group went to f
            worst = 0.0
            for k in range(len(labels)):
                shares = [(load[g][k] + (r[f"c{k}"] if g == f else 0)) / total[k] for g in range(folds)]
                m = sum(shares) / folds
                worst += sum((s - m) ** 2 for s in shares)
            return worst, size[f], f

        best = min(range(folds), key=cost)
        for k in range(len(labels)):
            load[best][k] += r[f"c{k}"]
        size[best] += r["n"]
        return best

    placed = [(r[group], deal(r)) for r in rows]
    fixed = spark.createDataFrame(placed, f"{group} {kind}, fold int")
    if not units:
        return fixed
    plan = []
    spare = max(folds - 1, SINGLY // len(units))
    for r in units:
        rounds = max(0, r["m"] - spare) // folds
        left = r["m"] - rounds * folds
        for f in range(folds):
            for k, c in enumerate(cs):
                load[f][k] += rounds * r[c]
            size[f] += rounds * r["n"]
        plan.append((r["n"], *[r[c] for c in cs], r["part"], rounds * folds, [deal(r) for _ in range(left)]))
    keys = ["n", *cs, "part"]
    dealt = spark.createDataFrame(plan, f"{', '.join(f'{k} bigint' for k in keys)}, full bigint, last array<int>")
    place = rest.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("h", group)) - 1).join(dealt, keys)
    fold = F.when(F.col("place") < F.col("full"), F.col("place") % folds).otherwise(F.get("last", F.col("place") - F.col("full")))
    return fixed.unionByName(place.select(group, fold.cast("int").alias("fold")))


def fold_split(fold: Column, test: int = 0, calibration: int = 1) -> Column:
    return F.when(fold == test, "test").when(fold == calibration, "calibration").otherwise("train")


def assign_split(df: DataFrame, assignment: DataFrame, key: str) -> DataFrame:
    """df with the split of its key; ValueError if the assignment has a key twice, which would multiply rows."""
    twice = assignment.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if twice:
        raise ValueError(f"{key} is not unique in the assignment")
    return df.join(assignment, key, "left")


def split_manifest(df: DataFrame, split: str, group: str, label: str) -> Mapping[str, object]:
    """Rows and labels for each split, groups in more than one split, and whether all gates hold."""
    per = {r[0]: r["n"] for r in df.groupBy(split).agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = [(r[0], r[1], r["n"]) for r in df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n")).collect()]
    leaks = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count_distinct(split).alias("n")).where("n > 1").count()
    gates = {"all_rows_have_split": None not in per, "no_group_overlap": leaks == 0, "calibration_not_empty": per.get("calibration", 0) > 0, "test_not_empty": per.get("test", 0) > 0}
    return {"split_counts": per, "labels": labels, "overlapping_groups": leaks, "gates": gates, "all_gates_passed": all(gates.values())}
