"""Session builder for tests, the benchmark and notebooks.

A cluster sets its own master, memory and ``spark.checkpoint.dir``; the values
here only fill in what a local run needs.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: str | int = 8, app: str = "textloom", memory: str | None = None) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory or os.environ.get("TEXTLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
