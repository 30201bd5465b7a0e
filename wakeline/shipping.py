"""Sending this package to the executors of a running session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the session's Python files, once an application; tasks can then import it."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        _sent.add(context.applicationId)
        root = Path(__file__).resolve().parent
        to = Path(tempfile.mkdtemp(prefix="wakeline-")) / "wakeline.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, Path("wakeline") / p.relative_to(root))
        context.addPyFile(str(to))
    return spark
