"""Session settings that every operator of the library relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: UTC keeps calendar operators equal on every machine; Arrow carries the few Python kernels.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cpus: int | None = None, shuffle_partitions: int | None = None, app: str = "strandline") -> SparkSession:
    """A session on this machine, for tests and the bench; a cluster passes its own session."""
    cpus = cpus or os.cpu_count() or 1
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
