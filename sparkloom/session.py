"""SparkSession factory used by tests, the bench and small jobs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | None = None, name: str = "sparkloom") -> SparkSession:
    """A local session; on a cluster the caller brings its own session and settings."""
    cores = cores or int(os.environ.get("SPARKLOOM_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(max(cores, 8)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARKLOOM_DRIVER_MEMORY", "6g"))
        .getOrCreate()
    )
