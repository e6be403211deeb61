"""A session with the settings these plans like; any other session works too."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "gradloom", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # A state table placed by idx also serves joins on (idx, k).
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
