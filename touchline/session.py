"""A Spark session with the settings the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "touchline", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI, adaptive execution with skew joins; further settings by keyword (dots as __)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    return builder.config(map=settings).getOrCreate()
