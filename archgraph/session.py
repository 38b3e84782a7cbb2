"""Session settings that the engine's semantics rest on."""

from pyspark.sql import SparkSession


def session(app: str = "archgraph", **conf: str) -> SparkSession:
    """UTC timestamps and adaptive plans; further settings by keyword with dots as double underscores."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
