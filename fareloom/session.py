"""Session construction for scripts and tests; library code takes the caller's session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, memory: str = "8g", app: str = "fareloom") -> SparkSession:
    """A local session with the settings the tests and ``bench.py`` rely on.

    On a cluster the session comes from ``spark-submit``; nothing in the
    package depends on the values set here.
    """
    cores = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Shuffles become tasks by size, not one per core; 4 MB suits a laptop-sized
        # table, a cluster keeps Spark's 64 MB.
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4m")
        .getOrCreate()
    )
