"""Sending this package to the executors, whose Python need not have it on its path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package's modules to the application, once."""
    sc = spark.sparkContext
    if getattr(ship, "application", None) == sc.applicationId:
        return
    top = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="docspend-")) / "docspend.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(out))
    ship.application = sc.applicationId
