"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Wall-clock timestamps need a fixed zone; the rest lets Spark re-plan joins,
#: skewed partitions and partition counts from what it measures at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build(app: str = "loomgrid", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | more)
    return (builder.master(master) if master else builder).getOrCreate()
