"""Session with the settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "storyloom", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; maps keep the last of repeated keys. conf overrides, dots as __."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN", "spark.sql.sources.partitionOverwriteMode": "dynamic"}
    return SparkSession.builder.appName(app).config(map=base | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
