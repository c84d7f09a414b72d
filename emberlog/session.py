"""Session settings that the language's semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "false",  # integers wrap, failed casts are null
    "spark.sql.caseSensitive": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

#: Settings that only a new session takes: columns are made without call sites, which cost more than the columns.
BUILT = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def session(name: str = "emberlog", **conf: str) -> SparkSession:
    """A session with the settings; further ones by keyword with _ for dots."""
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | BUILT).items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return configure(builder.getOrCreate())
