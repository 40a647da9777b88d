"""A session with the settings that the operators assume: UTC, Arrow, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "framewatch", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.adaptive.enabled": "true", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
