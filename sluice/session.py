"""A session with the settings that the library counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Times are UTC; joins and partitions adapt to what a query turns out to hold.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.parallelPartitionDiscovery.threshold": "32",
}


def session(name: str = "sluice", master: str | None = None, **settings: str) -> SparkSession:
    """settings: with underscores for dots; shuffle partitions are left to the cluster."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
