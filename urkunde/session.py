"""Session helper for local runs and tests; on a cluster the caller brings a session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session in UTC with adaptive execution."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("urkunde")
        .config("spark.driver.memory", os.environ.get("URKUNDE_DRIVER_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
