"""Session with the settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: A duplicate label in one sample overwrites, and all calendar work is in UTC.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(app: str = "fleetgauge", master: str | None = None, extra: dict | None = None) -> SparkSession:
    """Session under SETTINGS; settings already given by spark-submit stay unless named in extra."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | (extra or {}))
    return (builder.master(master) if master else builder).getOrCreate()
