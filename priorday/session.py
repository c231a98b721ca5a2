"""Session settings that the library's jobs expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def configured(builder: SparkSession.Builder | None = None) -> SparkSession:
    """A session with UTC times, ANSI arithmetic and adaptive execution on."""
    b = builder or SparkSession.builder.appName("priorday")
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
