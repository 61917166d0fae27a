"""Session settings that the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set what can be set at run time, and make the sources known."""
    from shardloom.sources.tarscan import register

    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    register(spark)
    return spark
