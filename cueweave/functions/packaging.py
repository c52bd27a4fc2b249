"""Makes the package importable in Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to all executors once per application (Spark's file server copies it; nothing is shared by path)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    with tempfile.TemporaryDirectory() as folder:
        staged = Path(folder, "stage", package.name)
        shutil.copytree(package, staged, ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(os.path.join(folder, package.name), "zip", Path(folder, "stage"))
        home = tempfile.mkdtemp(prefix="cueweave-py-")
        atexit.register(shutil.rmtree, home, ignore_errors=True)  # executors fetch the archive as long as the driver lives
        target = os.path.join(home, f"{package.name}.zip")
        shutil.copy(archive, target)
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)
