"""Reading: CSV with encoding fallback, Parquet, nested crawl JSON, golden labels, gazetteer, dictionaries."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import LABEL_IDS
from ..functions.text import filled, word_count
from ..schemas import CRAWL_FILE, GAZETTEER, GOLDEN


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None, encoding: str = "UTF-8", strict: bool = False) -> DataFrame:
    """Quoted fields may hold line ends and any length; without a schema all columns are text. Values that don't fit the
    schema are null, or, with strict, an error."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).option("maxCharsPerColumn", -1)
    r = r.option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return (r.schema(schema) if schema is not None else r).csv(path if isinstance(path, str) else list(path))


def read_csv_any(spark: SparkSession, path: str, schema: T.StructType | str | None = None, fallback: str = "ISO-8859-1") -> DataFrame:
    """As UTF-8, with a byte-order mark or without, or as the fallback if a line isn't UTF-8; the check reads lines as bytes
    until it finds one. A replacement character in valid UTF-8 is text like any other."""
    broken = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()
    return read_csv(spark, path, schema, fallback if broken else "UTF-8")


def read_any(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet, JSON lines or CSV by the suffix."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix in ("json", "jsonl"):
        return (spark.read.schema(schema) if schema is not None else spark.read).json(path)
    return read_csv(spark, path, schema)


def crawl_files(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each crawl file: source_file, meta, queries, records."""
    return spark.read.schema(CRAWL_FILE).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder).select(F.col("_metadata.file_name").alias("source_file"), "*")


def crawl_meta(files: DataFrame) -> DataFrame:
    return files.select("source_file", "meta")


def crawl_queries(files: DataFrame) -> DataFrame:
    return files.select("source_file", F.explode_outer("queries").alias("q")).select("source_file", "q.query_id", F.col("q.group").alias("query_group"), "q.query", F.col("q.status").alias("query_status"))


def golden_labels(spark: SparkSession, folder: str, pattern: str = "*_sentiment_labeling_output.json") -> DataFrame:
    """Rows of the label files of a folder, labels trimmed in lower case with their ids."""
    raw = spark.read.schema(GOLDEN).option("multiLine", True).option("pathGlobFilter", pattern).json(folder).select("*", F.col("_metadata.file_name").alias("golden_file"))
    return clean_golden(raw)


def clean_golden(raw: DataFrame) -> DataFrame:
    ids = F.create_map(*[F.lit(x) for kv in LABEL_IDS.items() for x in kv])
    label = F.lower(filled(F.col("sentiment")))
    return raw.withColumns({"sentiment_label": label, "label_id": ids[label], "original_text": F.coalesce("text_selected", F.lit(""))})


def first_filled(*columns: str):
    """The first column with a filled value, trimmed."""
    return F.coalesce(*[filled(F.col(c)) for c in columns])


def gazetteer(spark: SparkSession, *paths: str) -> DataFrame:
    """Province, regency and district files with one set of columns; a province file has no parent."""
    return spark.read.schema(GAZETTEER).option("header", True).csv(list(paths))


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Files that match a pattern, in any file system that Spark reads, sorted."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(str(f.getPath().toString()) for f in (found or []))


def golden_any(spark: SparkSession, folder: str, empty: str = "(kosong)") -> DataFrame:
    """golden_file, golden_row (from 1), text_id, sentiment, location, text, text_length, word_count of label files in any
    of the usual shapes: a list of rows, or an object with the rows under `data` or else `rows`; the text is the first
    filled one of text_selected, text and content, the label stands in `sentiment` or else `label`."""
    row = "array<struct<text_id:string,text_selected:string,text:string,content:string,sentiment:string,label:string,location:string>>"
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select("value", F.col("_metadata.file_name").alias("golden_file"))
    listed, under = F.from_json("value", row), F.from_json("value", f"struct<data:{row},rows:{row}>")
    rows = F.when(F.ltrim(F.regexp_replace("value", r"^\s+", "")).startswith("["), listed).otherwise(F.coalesce(under["data"], under["rows"]))
    r = raw.select("golden_file", F.posexplode(rows).alias("at", "r")).where("r IS NOT NULL")
    text = F.coalesce(filled(F.col("r.text_selected")), filled(F.col("r.text")), filled(F.col("r.content")), F.lit(""))
    out = r.select(
        "golden_file", (F.col("at") + 1).alias("golden_row"), F.coalesce(filled(F.col("r.text_id")), F.lit("")).alias("text_id"),
        F.coalesce(filled(F.coalesce("r.sentiment", "r.label")), F.lit(empty)).alias("sentiment"), F.coalesce(filled(F.col("r.location")), F.lit(empty)).alias("location"), text.alias("text"),
    )
    return out.withColumns({"text_length": F.length("text"), "word_count": word_count(F.col("text"))})


def keyword_lists(path: str | Path, keys: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """The lists of a keyword resource under the given keys, in lower case with single blanks, each term once; KeyError for
    a missing key, ValueError for anything but a list of texts."""
    data = read_object(path)
    missing = [k for k in keys if k not in data]
    if missing:
        raise KeyError(f"{path}: missing {missing}")
    out = {}
    for k in keys:
        if not isinstance(data[k], list) or not all(isinstance(x, str) for x in data[k]):
            raise ValueError(f"{path}: {k} is no list of texts")
        out[k] = tuple(dict.fromkeys(t for x in data[k] if (t := " ".join(x.casefold().split()))))
    return out


def used_urls(spark: SparkSession, folder: str, pattern: str = "*candidate*.csv", column: str = "source_url", answered: bool = True) -> DataFrame:
    """Distinct addresses of the candidate files of a folder; with `answered` only of files beside which there is a file
    of labels. The driver lists names only."""
    files = list_files(spark, f"{folder.rstrip('/')}/{pattern}")
    if answered:
        files = [f for f in files if list_files(spark, f"{f.rpartition('/')[0]}/{f.rpartition('/')[2].split('candidate')[0].removesuffix('.csv')}*sentiment_labeling_output*.json")]
    if not files:
        return spark.createDataFrame([], f"{column} string")
    return read_csv(spark, files).select(filled(F.col(column)).alias(column)).where(f"{column} IS NOT NULL").distinct()


def read_object(path: str | Path, missing_ok: bool = False) -> dict:
    """A JSON object; ValueError for another shape; an empty one for a missing file on demand."""
    p = Path(path)
    if not p.exists() and missing_ok:
        return {}
    data = json.loads(p.read_text(encoding="utf-8"))
    if not isinstance(data, dict):
        raise ValueError(f"{path}: not a JSON object")
    return data


def read_dictionary(path: str | Path) -> dict[str, str]:
    """Word to word, keys in lower case; empty for a missing file."""
    return {str(k).lower(): str(v) for k, v in read_object(path, missing_ok=True).items()}


def read_list(path: str | Path) -> list[str]:
    """A JSON list of texts, each once in its order; ValueError for another shape."""
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(data, list):
        raise ValueError(f"{path}: not a JSON list")
    return list(dict.fromkeys(str(x).strip() for x in data if str(x).strip()))


def latest_checkpoint(folder: str | Path, name: str = "trainer_state.json") -> Path | None:
    """The log of the checkpoint with the greatest number in a training folder, else the folder's own, else none."""
    root = Path(folder)
    numbered = [(int(p.parent.name.rpartition("-")[2]), p) for p in root.glob(f"checkpoint-*/{name}") if p.parent.name.rpartition("-")[2].isdigit()]
    own = root / name
    return max(numbered)[1] if numbered else own if own.exists() else None


def training_history(path: str | Path) -> list[dict]:
    """Numeric entries of a trainer's log, in their order."""
    log = read_object(path, missing_ok=True).get("log_history", [])
    return [{k: v for k, v in row.items() if isinstance(v, (int, float)) and not isinstance(v, bool)} for row in log if isinstance(row, dict)]
