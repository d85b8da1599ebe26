"""SparkSession factory."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tabsignal", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings given override these."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.scheduler.mode": "FAIR",
    }
    builder = SparkSession.builder.appName(app)
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
