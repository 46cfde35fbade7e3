"""Sessions with the settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tapeglass", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` adds settings (underscores for dots)."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()
