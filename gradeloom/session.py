"""The engine's Spark session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "gradeloom", master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A session with adaptive execution and UTC times; master and sizes are the cluster's unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if (master or "").startswith("local"):
        defaults |= {"spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("GRADELOOM_DRIVER_MEMORY", "8g")}
    for key, value in (defaults | extra).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
