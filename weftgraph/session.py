"""What a session needs before a query runs."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it.

    That serves one machine and shared file systems; elsewhere the package is passed by --py-files.
    """
    environment = spark.sparkContext.environment
    parts = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in parts:
        environment["PYTHONPATH"] = ":".join([ROOT, *parts])
    return spark
