"""Session settings the assessment profits from."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # The JVM does not compile methods above 8000 bytes, and wide row-wise
    # stages reach that. Below the limit Spark splits them into smaller ones.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Samples joined to a table too large to broadcast are not sorted for it, and so not
    # spilled, where every task's share of that table is known to be small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session. Runtime settings only, no restart."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark
