"""Session defaults used by tests, the bench and local runs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(master: str = "local[8]", partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow transfer; `extra` adds or overrides settings."""
    conf = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | extra
    session = SparkSession.builder.master(master).appName("corvane").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
