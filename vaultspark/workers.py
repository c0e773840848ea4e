"""Python workers: where they find this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Put this package's folder on the workers' path; a cluster without shared folders ships it with --py-files."""
    paths = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[1])
    if root not in paths.get("PYTHONPATH", "").split(os.pathsep):
        paths["PYTHONPATH"] = os.pathsep.join(filter(None, [root, paths.get("PYTHONPATH")]))
