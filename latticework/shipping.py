"""The package's own code for executors whose Python doesn't find it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers of this application, once."""
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    home = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="latticework-code-"), "latticework.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(home.rglob("*.py")):
            archive.write(path, Path(home.name) / path.relative_to(home))
    context.addPyFile(target)
    _done.add(context.applicationId)
