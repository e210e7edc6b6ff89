"""Projection, row order, keep-first de-duplication, set checks and ranked selection."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_filled
from ..tables import stored


def ordered_columns(df: DataFrame, first: Sequence[str], last: Sequence[str] = ()) -> DataFrame:
    """The named columns that there are, then all others, then `last`."""
    head = [c for c in first if c in df.columns and c not in last]
    tail = [c for c in last if c in df.columns]
    return df.select(*head, *[c for c in df.columns if c not in head and c not in tail], *tail)


def all_of(conditions: Iterable[Column]) -> Column:
    """True without conditions."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def not_in(column: Column, values: Sequence) -> Column:
    """Rows whose value is none of the list; a null value is not kept, as in SQL."""
    return ~column.isin(list(values)) if values else column.isNotNull()


def row_ids(df: DataFrame, order: Sequence[Column | str], prefix: str = "", width: int = 4, column: str = "row_id") -> DataFrame:
    """1, 2, ... in the order, as numbers or, with a prefix, as text. Numbering all rows of a table is two passes: rows are
    range-partitioned by the order, counted for each partition, and numbered inside it, so no task holds the table."""
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    # range bounds come from a sample, so the partitions are written down before they are counted
    spread = stored(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row for each partition
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = spread.withColumn("_k", F.row_number().over(W.partitionBy("_part").orderBy(*keys))).join(F.broadcast(before), "_part")
    n = F.col("_k") + F.col("_before")
    value = F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0")) if prefix else n
    wide = F.when(F.length(n.cast("string")) > width, F.concat(F.lit(prefix), n.cast("string"))).otherwise(value) if prefix else n
    return numbered.withColumn(column, wide).drop("_part", "_k", "_before")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Of the rows with the same keys (null equal to null) the first by the order: one shuffle by the keys. Aggregating
    the whole row combines on the map side, so that a key with a third of all rows is no hot task."""
    # the order's values lead the struct, so min() picks the first row
    names = df.columns
    lead = [(F.col(o) if isinstance(o, str) else o).alias(f"_o{k}") for k, o in enumerate(order)]
    best = F.min(F.struct(*lead, F.struct(*names).alias("_row"))).alias("_best")
    return df.groupBy(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)]).agg(best).select("_best._row.*")


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> Column:
    """Aggregate: rows less distinct keys, nulls being values."""
    return F.count(F.lit(1)) - F.count_distinct(F.struct(*[F.col(k) for k in keys]))


def top_n(df: DataFrame, by: Sequence[Column], n: int, within: Sequence[str] = (), rank: str = "rank") -> DataFrame:
    """The first n rows of the order, ranked, in each group; without groups a limited sort comes first."""
    if not within:
        df = df.orderBy(*by).limit(n)
    w = (W.partitionBy(*within) if within else W.partitionBy(F.lit(0))).orderBy(*by)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def head(df: DataFrame, n: int | None, order: Sequence[Column | str]) -> DataFrame:
    """The first n rows; all without n; ValueError for n below 1."""
    if n is None:
        return df
    if n < 1:
        raise ValueError("the limit must be positive")
    return df.orderBy(*order).limit(n)


def mode_first(df: DataFrame, group: Sequence[str], value: str, position: str) -> DataFrame:
    """The most frequent value of each group; of equals the one seen first."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"), F.min(position).alias("_p"))
    return counts.groupBy(*group).agg(F.max_by(value, F.struct(F.col("_n"), -F.col("_p"))).alias(value), F.max("_n").alias("n"))


def shared_groups(df: DataFrame, split: str, group: str) -> DataFrame:
    """Groups that occur in more than one split: group, splits."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def values_outside(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    return df.select(column).where(~F.col(column).isin(list(allowed)) | F.col(column).isNull()).distinct()


def unpivot_filled(df: DataFrame, columns: Sequence[str], name: str = "kolom", value: str = "nilai") -> DataFrame:
    """A row for each of the columns that is filled, in one pass over the table."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("string").alias(value)) for c in columns])
    return df.select(*[c for c in df.columns if c not in (name, value)], F.explode(pairs).alias("_p")).select("*", f"_p.{name}", f"_p.{value}").drop("_p").where(is_filled(F.col(value)))


def next_number(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """One row: the greatest number after the prefix, and one more."""
    n = F.regexp_extract(F.col(column), rf"^{prefix}-(\d+)$", 1)
    return df.agg((F.coalesce(F.max(F.when(n != "", n.cast("bigint"))), F.lit(0)) + 1).alias("next_number"))
