"""The session settings that the engine's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Instants are UTC and written in a form all readers share; plans are re-made at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def session(app: str = "chronofold", **options: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | options).items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())
