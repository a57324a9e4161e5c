"""Session defaults of the jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "feedmill", cores: int | str = "*", **conf) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session at hand with the same SQL settings."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(name)
    defaults = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "16", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
        "spark.sql.autoBroadcastJoinThreshold": "10m",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
