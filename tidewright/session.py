"""Session settings the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller's session is used as it is."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tidewright")
    conf = {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        # plans of long analyses are large, and a session would keep the last thousand of them as text
        "spark.sql.ui.retainedExecutions": "2",
        "spark.sql.maxPlanStringLength": "100000",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
