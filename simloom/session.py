"""Session settings that the engine is tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, memory: str = "8g", app: str = "simloom") -> SparkSession:
    """A local session for tests and benches; on a cluster the submitter's session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("SIMLOOM_DRIVER_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
