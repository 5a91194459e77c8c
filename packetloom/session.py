"""A Spark session with the settings the package relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC everywhere: event times are instants, windows are aligned to the epoch.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """The active session, or a new one; settings with dots are given as a mapping in ``settings``."""
    builder = SparkSession.builder.appName("packetloom")
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | settings).getOrCreate()
