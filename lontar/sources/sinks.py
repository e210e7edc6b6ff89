"""Writing: tables in versioned folders, small JSON artefacts, file hashes and manifests."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat_for_csv(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, as CSV needs."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields])


def save(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """By the suffix as Parquet, JSON lines or CSV; a table that is there is an error unless the mode says otherwise."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    w = (df if suffix in ("parquet", "json", "jsonl") else flat_for_csv(df)).write.mode(mode)
    if suffix == "parquet":
        w.parquet(path)
    elif suffix in ("json", "jsonl"):
        w.json(path)
    else:
        # values as they are, with the blanks at their ends
        w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def save_version(df: DataFrame, folder: str, name: str, stamp: datetime | None = None) -> str:
    """A new version of a table beside the older ones, which stay as its backups."""
    at = (stamp or datetime.now(timezone.utc)).strftime("%Y%m%dT%H%M%S")
    return save(df, f"{folder.rstrip('/')}/{name}/{at}.parquet")


def save_json(payload: object, path: str | Path) -> Path:
    """UTF-8 with indent 2, put in place by renaming, so that readers never see half a file."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=p.parent, suffix=".tmp")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(payload, f, ensure_ascii=False, indent=2, default=str)
    os.replace(tmp, p)
    return p


def file_sha256(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def manifest(df: DataFrame, source: str | None = None) -> dict[str, object]:
    out: dict[str, object] = {"rows": df.count(), "columns": df.columns, "column_count": len(df.columns)}
    if source and Path(source).is_file():
        out |= {"source_path": source, "source_sha256": file_sha256(source)}
    return out


def config_snapshot() -> dict[str, object]:
    from .. import config

    return {k: v for k, v in vars(config).items() if k.isupper() and not k.startswith("_")}


def experiment_dir(root: str | Path, name: str) -> Path:
    p = Path(root) / name
    p.mkdir(parents=True, exist_ok=True)
    return p
