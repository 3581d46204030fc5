"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "kinfabric", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; everything else comes from spark-submit or ``conf``."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
