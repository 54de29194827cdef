"""Hands the package to the executors, for sessions that don't have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip to the session's application, once."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    if package.parent.is_dir():  # not already run from a zip
        target = Path(tempfile.mkdtemp(prefix="lotwise-")) / "lotwise.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            for path in sorted(package.rglob("*.py")):
                archive.write(path, path.relative_to(package.parent))
        context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)
