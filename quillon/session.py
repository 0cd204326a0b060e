"""The Spark session that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "quillon", **conf: str) -> SparkSession:
    """A session in UTC with adaptive plans; conf adds or overrides settings (dots written as __)."""
    builder = SparkSession.builder.appName(name)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # the stricter rule for late rows: a window that the watermark has passed takes no row of the next batch
        "spark.sql.streaming.statefulOperator.allowMultiple": "false",
    }
    for key, value in (fixed | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
