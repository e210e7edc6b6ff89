"""Intermediate tables in the folder that all executors share: lineage ends there, and lost executors cost nothing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from `spark.checkpoint.dir`; a temporary one only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _made.setdefault("local", [tempfile.mkdtemp(prefix="lontar-")])[0]
    return folder.rstrip("/")


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """df written as parquet to the shared folder and read back. It runs when the query is built; later steps only read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lontar-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _made.setdefault("paths", []).append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._lontar_path = path
    return back


def forget(df: DataFrame | None) -> None:
    """Deletes a table of stored() that no later step reads."""
    path = getattr(df, "_lontar_path", None)
    if path:
        _delete(df.sparkSession, path)
        if path in _made.get("paths", []):
            _made["paths"].remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for path in _made.pop("paths", []):
        try:
            if spark is not None:
                _delete(spark, path)
        except Exception:
            pass
    for path in _made.pop("local", []):
        shutil.rmtree(path, ignore_errors=True)
