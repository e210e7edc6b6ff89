"""The package's own code on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each application, so that Python functions find it there."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        if root.is_dir():
            fd, path = tempfile.mkstemp(prefix="lontar-", suffix=".zip")
            os.close(fd)
            with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
                for p in sorted(root.rglob("*")):
                    if p.suffix in (".py", ".json", ".csv", ".txt"):
                        z.write(p, f"{root.name}/{p.relative_to(root).as_posix()}")
            sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return spark
