"""Session settings for local runs; a cluster brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", **extra: str) -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName("plumbline")
               .config("spark.sql.shuffle.partitions", "8").config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "12g").config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
