"""A session with the settings that the results depend on."""

from pyspark.sql import SparkSession


def session(name: str = "quire", **conf: str) -> SparkSession:
    """UTC days, ANSI casts, adaptive plans; the rest is the cluster's."""
    builder = SparkSession.builder.appName(name)
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
