"""Counts, distributions and quality summaries; each is one aggregation over the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import histogram_bin
from ..functions.text import filled, is_filled, value_list
from .relational import unpivot_filled


def distribution(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("jumlah"))


def column_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """kolom, nilai, jumlah for each value of each column, blank ones apart: one scan, one shuffle."""
    return unpivot_filled(df.select(*columns), columns).groupBy("kolom", "nilai").agg(F.count(F.lit(1)).alias("jumlah"))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """A row for each value of `row`, a count for each of the given values of `column`."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def quality(df: DataFrame, text: str, source: str) -> DataFrame:
    """One row: rows, null and blank texts, blank sources, duplicates by source and text, mean length to two digits."""
    t = F.col(text)
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(t.isNull()).alias("null_text"),
        F.count_if(t.isNotNull() & ~is_filled(t)).alias("empty_text"),
        F.count_if(~is_filled(F.col(source))).alias("empty_source"),
        # the text's 128-bit digest stands for it, so that no whole text is shuffled
        (F.count(F.lit(1)) - F.count_distinct(F.struct(F.col(source).alias("s"), F.md5(t).alias("t")))).alias("duplicates"),
        F.coalesce(F.round(F.avg(F.length(t)), 2), F.lit(0.0)).alias("mean_length"),
    )


def validate(df: DataFrame, required: Sequence[str], text: str = "text", source: str = "source") -> dict[str, object]:
    """Missing columns and, in one aggregation, unusable texts and sources; with the findings in words."""
    missing = [c for c in required if c not in df.columns]
    counts = {"null_text": 0, "empty_text": 0, "empty_source": 0}
    aggs = [F.count(F.lit(1)).alias("total_rows")]
    if text in df.columns:
        aggs += [F.count_if(F.col(text).isNull()).alias("null_text"), F.count_if(F.col(text).isNotNull() & ~is_filled(F.col(text))).alias("empty_text")]
    if source in df.columns:
        aggs.append(F.count_if(~is_filled(F.col(source))).alias("empty_source"))
    row = df.agg(*aggs).first().asDict()
    counts |= {k: row[k] for k in counts if k in row}
    issues = [f"missing columns: {missing}"] * bool(missing) + [f"{n} rows: {k}" for k, n in counts.items() if n]
    return {"total_rows": row["total_rows"], "required_columns": list(required), "missing_columns": missing, **counts, "is_valid": not issues, "issues": issues}


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """kolom, filled, empty, unique, percent for each column; one aggregation, reshaped in its single row."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for k, c in enumerate(columns):
        v = filled(F.col(c).cast("string"))
        aggs += [F.count(v).alias(f"f{k}"), F.count_distinct(v).alias(f"u{k}")]
    rows = F.array(*[F.struct(F.lit(c).alias("kolom"), F.col(f"f{k}").alias("filled"), (F.col("_n") - F.col(f"f{k}")).alias("empty"), F.col(f"u{k}").alias("unique"),
                              F.when(F.col("_n") > 0, F.round(100.0 * F.col(f"f{k}") / F.col("_n"), 2)).otherwise(0.0).alias("percent")) for k, c in enumerate(columns)])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def list_counts(df: DataFrame, column: str, sep: str = ",") -> DataFrame:
    """Occurrences of each value of a delimited list."""
    return df.select(F.explode(value_list(F.col(column), sep)).alias("nilai")).groupBy("nilai").agg(F.count(F.lit(1)).alias("jumlah"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    v = F.col(column).cast("double")
    return df.where(v.isNotNull()).groupBy(histogram_bin(v, low, high, bins).alias("bin")).agg(F.count(F.lit(1)).alias("jumlah"))


def report_column(df: DataFrame, choices: Sequence[str], allowed: Sequence[str], empty: str) -> tuple[DataFrame, str]:
    """(df with report_value, name of the column that it comes from): the first of the columns that has a value of the
    domain at all; the last of them counts without one, its values outside the domain being `empty`. One aggregation
    decides; without any of the columns all values are `empty`."""
    have = [c for c in choices if c in df.columns]
    if not have:
        return df.withColumn("report_value", F.lit(empty)), empty
    n = df.agg(*[F.count_if(F.col(c).isin(*allowed)).alias(f"n{k}") for k, c in enumerate(have)]).first()
    chosen = next((c for k, c in enumerate(have[:-1]) if n[k]), have[-1])
    value = F.coalesce(filled(F.col(chosen)), F.lit(empty)) if chosen != choices[-1] else F.when(F.col(chosen).isin(*allowed), F.col(chosen)).otherwise(empty)
    return df.withColumn("report_value", value), chosen


def gates(df: DataFrame, **bad: object) -> DataFrame:
    """One row with a boolean for each named condition: whether no row meets it."""
    return df.agg(*[(F.count_if(c) == 0).alias(name) for name, c in bad.items()])


def coverage(dim: DataFrame, facts: DataFrame, key: str, low: int = 1) -> DataFrame:
    """Every entry of the dimension with its number of facts, 0 included, and whether that is below `low`."""
    n = facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return dim.join(n, key, "left").withColumn("jumlah", F.coalesce("n", F.lit(0))).drop("n").withColumn("is_low", F.col("jumlah") < low)


def combination_audit(left: DataFrame, raw: DataFrame, ready: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key combination with its counts in two further tables, 0 where it is missing."""
    a = raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("raw_count"))
    b = ready.groupBy(*keys).agg(F.count(F.lit(1)).alias("ready_count"))
    out = left.join(a, list(keys), "left").join(b, list(keys), "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("raw_count", "ready_count")})
