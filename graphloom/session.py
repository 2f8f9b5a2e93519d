"""SparkSession builder for local runs; on a cluster, use the session you are given."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(name: str = "graphloom", cores: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session: adaptive execution on, as many shuffle partitions as cores, UTC."""
    cores = cores or os.cpu_count() or 4
    settings = {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    spark = SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
