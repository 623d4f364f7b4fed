"""Sessions with the settings that the engine assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "textloom", master: str | None = None, partitions: int | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; master and partitions are for local runs, a cluster has its own."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
