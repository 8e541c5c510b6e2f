"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that results depend on, and those that plans should have.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cbo.enabled": "true",
    "spark.sql.cbo.joinReorder.enabled": "true",
}


def session(app: str = "tesserql", **extra: str) -> SparkSession:
    """A session with the package's defaults; ``extra`` adds or overrides."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
