"""A Spark session with settings that suit columnar analytics."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(master: str | None = None, name: str = "stripelake", **conf: str) -> SparkSession:
    """Adaptive execution splits skewed joins and sizes shuffles; everything can be overridden by ``conf`` (dots as double underscores)."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.parquet.enableVectorizedReader": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
