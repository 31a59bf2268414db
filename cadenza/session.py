"""A Spark session for tests and benchmarks on one machine."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", memory: str = "12g") -> SparkSession:
    """Local session; on a cluster, pass your own session to the library instead.

    The adaptive settings are what the library counts on everywhere: joins on user or item ids
    may be skewed, and Spark then splits the large partitions at run time.
    """
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cadenza")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
