"""Sessions: UTC, adaptive execution, microsecond Parquet timestamps."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What results depend on, or what every run wants; sizes (memory, shuffle width) are the cluster's to say.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}


def build_session(name: str = "quern", local_cores: int | None = None, **settings: str) -> SparkSession:
    """A session with ``SETTINGS``; ``local_cores`` runs it in this process with as many shuffle partitions."""
    builder = SparkSession.builder.appName(name)
    if local_cores:
        builder = builder.master(f"local[{local_cores}]").config("spark.sql.shuffle.partitions", str(local_cores)).config("spark.ui.enabled", "false")
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    pin_utc(spark)
    return spark


def pin_utc(spark: SparkSession) -> None:
    """Also on a session that something else has built."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
