"""The row-local operators on streams, and de-duplication within a watermark."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import clean_text
from ..functions.urls import normal_url
from ..operators.fusion import fuse
from ..operators.lexicon import Rules, score_texts
from ..operators.providers import from_logits


def read_rows(spark: SparkSession, folder: str, schema: T.StructType | str, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def prepare_stream(rows: DataFrame, time: str, lateness: str = "1 hour", slang: Mapping[str, str] | None = None) -> DataFrame:
    """Cleaned rows, each address and text once within the watermark: the state is a hash for each pair of its span."""
    out = rows.withColumns({"processed_text": clean_text(F.col("text"), slang), "normalized_source_url": normal_url(F.coalesce("source_url", F.lit("")))})
    out = out.where(F.col("processed_text") != "").withColumn("_pair", F.xxhash64("normalized_source_url", "processed_text"))
    return out.withWatermark(time, lateness).dropDuplicatesWithinWatermark(["_pair"]).drop("_pair")


def decide_stream(prepared: DataFrame, logits: Sequence[str], rules: Rules | None = None) -> DataFrame:
    return fuse(from_logits(score_texts(prepared, "processed_text", rules), logits))


def windowed_counts(decided: DataFrame, time: str, window: str = "1 hour") -> DataFrame:
    """Decisions for each event-time window, label and action."""
    return decided.groupBy(F.window(time, window).alias("w"), "final_sentiment", "fusion_action").agg(F.count(F.lit(1)).alias("jumlah")).select(F.col("w.start").alias("window_start"), "final_sentiment", "fusion_action", "jumlah")


def write_rows(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """To Parquet with exactly-once bookkeeping in the checkpoint folder."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
