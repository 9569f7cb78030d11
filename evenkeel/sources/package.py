"""Executors import this package too: it is added to the session's Python files once."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_NAME = "evenkeel"


def ship(spark: SparkSession) -> None:
    """Distribute the package's modules with ``addPyFile``; Spark copies the archive to every executor."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent.parent
    if getattr(sc, "_shipped_package", None) == _NAME or not root.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="spark-")) / f"{_NAME}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{_NAME}/{f.relative_to(root)}")
    sc.addPyFile(str(path))
    sc._shipped_package = _NAME
