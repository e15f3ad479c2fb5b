"""A local session with the settings the queries assume."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(name: str = "codexlake", cores: int | str | None = None, partitions: int = 8) -> SparkSession:
    """A ``local[n]`` session in UTC with adaptive execution; on a cluster use the cluster's own session."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
