"""The session as the library expects it, and its code on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def build(name: str = "collegium", **options: str) -> SparkSession:
    """A session in UTC with adaptive execution; options are Spark settings with underscores for dots."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in options.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's code to the executors, once for each application, unless PYTHONPATH has it there."""
    app = spark.sparkContext.applicationId
    if app in _shipped or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return spark
    fd, path = tempfile.mkstemp(prefix="collegium-code-", suffix=".zip")
    with os.fdopen(fd, "wb") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as code:
        for f in sorted((ROOT / "collegium").rglob("*.py")):
            code.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
    return spark
