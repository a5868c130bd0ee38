"""Session with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "latticework", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling, Arrow for Python stages; conf adds or replaces settings."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return b.config(map=settings).getOrCreate()
