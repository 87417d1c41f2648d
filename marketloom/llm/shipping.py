"""Sends this package to the executors, so that functions that run there can import it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp()).resolve() / f"{package.name}_code.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _SENT.add(app)
