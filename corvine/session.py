"""Session settings that the library's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; ``conf`` has more of them by name."""
    builder = SparkSession.builder.appName("corvine").config(map=SETTINGS | conf)
    return (builder.master(master) if master else builder).getOrCreate()
