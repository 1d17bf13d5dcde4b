"""The published weather table: a complete grid of hours and sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite_or_null
from ..schemas import WEATHER_COLUMNS

VARIABLES = list(WEATHER_COLUMNS.values())


def prepare(weather: DataFrame, site_ids: Sequence[str], start: str, end: str) -> DataFrame:
    """Average duplicate keys, then left join to the grid of the given sites; not finite becomes null."""
    spark = weather.sparkSession
    rows = weather.where(F.col("site_id").isin(*site_ids) & F.col("timestamp").isNotNull())
    rows = rows.groupBy("timestamp", "site_id").agg(*[F.avg(finite_or_null(F.col(v))).alias(v) for v in VARIABLES])
    sites = spark.createDataFrame([(s,) for s in sorted(set(site_ids))], "site_id string")
    hours = F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), F.expr("INTERVAL 1 HOUR"))
    return sites.select("site_id", F.explode(hours).alias("timestamp")).join(rows, ["timestamp", "site_id"], "left").select("timestamp", "site_id", *VARIABLES)


def missing_rates(weather: DataFrame, variables: Sequence[str] = VARIABLES) -> DataFrame:
    """site_id, variable, missing_rate."""
    rates = weather.groupBy("site_id").agg(*[F.avg(F.col(v).isNull().cast("int")).alias(v) for v in variables])
    return rates.unpivot(["site_id"], list(variables), "variable", "missing_rate")


def violations(weather: DataFrame) -> list[str]:
    if weather.columns != ["timestamp", "site_id", *VARIABLES]:
        return [f"columns are {weather.columns}"]
    out = []
    if not weather.where("timestamp IS NULL OR site_id IS NULL").isEmpty():
        out.append("keys are missing")
    if not weather.groupBy("timestamp", "site_id").count().where("count > 1").isEmpty():
        out.append("keys are not unique")
    return out
