"""Session settings shared by tests, bench and ad-hoc runs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and bench; on a cluster, pass your own session to the operators."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("causeway")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", os.environ.get("SPARK_LOCAL_DIRS", "/tmp/spark-local"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
