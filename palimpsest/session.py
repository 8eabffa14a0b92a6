"""The session: settings that hold on a laptop and on a cluster alike."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Only what the results or the plans depend on; sizes and memory belong to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local(cores: int = 8, memory: str = "8g", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("palimpsest").config("spark.ui.enabled", "false")
    b = b.config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", memory)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores)).config("spark.driver.host", "127.0.0.1")
    for k, v in {**SETTINGS, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
