"""Sessions with the settings the engine counts on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution. Without a master, the one that spark-submit names."""
    b = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", os.environ.get("TIDEMARK_MEMORY", "8g"))
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
