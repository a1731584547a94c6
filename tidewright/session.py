"""The session that the library expects."""

from pyspark.sql import SparkSession


def session(name: str = "tidewright", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution, skew joins and zstd output; settings override the defaults."""
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.sql.codegen.maxFields": "400",
    }
    return SparkSession.builder.appName(name).config(map=defaults | {k.replace("__", "."): v for k, v in settings.items()}).getOrCreate()
