"""Session factory: the settings every operator of this package is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC keeps timestamps equal on every machine; ANSI turns silent overflow into an error; AQE re-plans joins and
#: partition counts from measured sizes, so no operator here fixes them by hand.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(app: str = "corvane", master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; ``more`` overrides them, dots written as double underscores."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
