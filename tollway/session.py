"""Spark settings the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Hot join keys are split at run time, and shuffles start with many small partitions that
# are put together by their measured size.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    # no Python stack trace for every column expression; plans are built several times faster
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def with_settings(builder: SparkSession.Builder, shuffle_partitions: int) -> SparkSession.Builder:
    """Set them on a session builder.

    `shuffle_partitions` should be two to four times the cluster's cores for large runs. A
    streaming query keeps the number it was first started with.
    """
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
