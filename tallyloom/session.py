"""The session that tests, the bench and small runs use; a cluster brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: str = "8", memory: str = "8g", partitions: int = 8) -> SparkSession:
    settings = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.driver.memory": memory, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    return SparkSession.builder.master(f"local[{cores}]").appName("tallyloom").config(map=settings).getOrCreate()
