"""Direct 1 to 24 hour examples from daily origins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cyclic, plus_hours
from .features import assert_hourly
from .split import Split
from .windows import feature_min_periods, ordered, rolling

# The number of horizons and the feature names.
HORIZONS = 24
NUMERIC = [
    "origin_load", "origin_lag_24", "origin_lag_48", "origin_lag_168", "origin_rolling_mean_24", "origin_rolling_std_24",
    "origin_rolling_mean_168", "origin_rolling_std_168", "horizon_hours", "direct_lag_24", "direct_lag_168",
    "target_hour_sin", "target_hour_cos", "target_dow_sin", "target_dow_cos",
]
WEATHER = [
    "origin_air_temperature", "origin_air_temperature_lag_24", "origin_air_temperature_lag_168",
    "origin_dew_temperature", "origin_wind_speed", "origin_air_temperature_mean_24",
]


def origin_features(panel: DataFrame) -> DataFrame:
    """Lags and statistics of windows that end at the row itself."""
    w, x = ordered("building_id"), F.col("load")
    columns = {"origin_load": x} | {f"origin_lag_{k}": F.lag(x, k).over(w) for k in (24, 48, 168)}
    for size in (24, 168):
        columns[f"origin_rolling_mean_{size}"] = rolling(x, "mean", size, feature_min_periods(size), w)
        columns[f"origin_rolling_std_{size}"] = rolling(x, "std", size, feature_min_periods(size), w)
    return panel.withColumns(columns)


def origin_weather(weather: DataFrame) -> DataFrame:
    w, air = ordered("site_id"), F.col("air_temperature")
    return weather.select(
        F.col("timestamp").alias("forecast_origin"), "site_id", air.alias("origin_air_temperature"),
        F.lag(air, 24).over(w).alias("origin_air_temperature_lag_24"), F.lag(air, 168).over(w).alias("origin_air_temperature_lag_168"),
        F.col("dew_temperature").alias("origin_dew_temperature"), F.col("wind_speed").alias("origin_wind_speed"),
        rolling(air, "mean", 24, 6, w).alias("origin_air_temperature_mean_24"),
    )


def examples(panel: DataFrame, *, origin_hour: int = 23, weather: DataFrame | None = None, check: bool = True) -> DataFrame:
    """One row per origin, entity and horizon; only origins with all 24 targets.

    Targets, and the readings 24 and 168 hours before them, come from one
    window over the entity's grid: on an hourly grid the reading h hours ahead
    is h rows ahead, which is checked on the timestamps, so no self join runs.
    """
    if not 0 <= origin_hour <= 23:
        raise ValueError("origin_hour lies in 0..23")
    if check:
        assert_hourly(panel)
    w = ordered("building_id")
    ahead = w.rowsBetween(1, HORIZONS)
    back, week = w.rowsBetween(1 - HORIZONS, 0), w.rowsBetween(1 - 168, HORIZONS - 168)
    slot = lambda: F.struct(F.col("timestamp").alias("t"), F.col("load").alias("v"))
    df = origin_features(panel).withColumns(
        {
            "targets__": F.collect_list(slot()).over(ahead),
            "day__": F.collect_list(slot()).over(back),
            "week__": F.collect_list(slot()).over(week),
        }
    )
    origins = df.where((F.hour("timestamp") == origin_hour) & (F.size("targets__") == HORIZONS))
    origins = origins.withColumnRenamed("timestamp", "forecast_origin").withColumn("horizon_hours", F.explode(F.sequence(F.lit(1), F.lit(HORIZONS))))
    target = plus_hours(F.col("forecast_origin"), F.col("horizon_hours"))

    def at(column: str, hours_back: int) -> Column:
        found = F.filter(column, lambda s: s["t"] == plus_hours(F.col("target_timestamp"), F.lit(-hours_back)))
        return F.get(found, F.lit(0))["v"]

    out = origins.withColumn("target_timestamp", target).withColumns(
        {"condition_target": at("targets__", 0), "direct_lag_24": at("day__", 24), "direct_lag_168": at("week__", 168), "cutoff_timestamp": F.col("forecast_origin")}
    )
    hour, dow = cyclic(F.hour("target_timestamp"), 24), cyclic(F.weekday("target_timestamp"), 7)
    out = out.withColumns({"target_hour_sin": hour[0], "target_hour_cos": hour[1], "target_dow_sin": dow[0], "target_dow_cos": dow[1]})
    out = out.drop("targets__", "day__", "week__", "load")
    if weather is not None:
        out = out.join(origin_weather(weather), ["site_id", "forecast_origin"], "left")
    return out


def origin_ranges(rows: DataFrame) -> DataFrame:
    """forecast_origin, low, high, targets: one small row an origin, whatever its number of entities."""
    times = rows.select("forecast_origin", "target_timestamp").distinct()
    return times.groupBy("forecast_origin").agg(
        F.min("target_timestamp").alias("low"), F.max("target_timestamp").alias("high"), F.count(F.lit(1)).alias("targets")
    )


def origin_partitions(rows: DataFrame, split: Split) -> DataFrame:
    """``partition`` by the target times of the whole origin; origins across a boundary are left out of all."""
    t, v, e = (F.lit(x).cast("timestamp_ntz") for x in (split.train_end, split.validation_end, split.test_end))
    low, high = F.col("low"), F.col("high")
    label = (
        F.when(F.col("targets") != HORIZONS, "excluded_incomplete_origin").when(high <= t, "train")
        .when((low > t) & (high <= v), "validation").when((low > v) & (high <= e), "test").otherwise("excluded_boundary_straddle")
    )
    return rows.join(origin_ranges(rows).select("forecast_origin", label.alias("partition")), "forecast_origin")


def assert_cutoff(fault_cutoff: str, train_end: str) -> None:
    """Faults may end no later than the first hour after training."""
    from datetime import datetime, timedelta

    if datetime.fromisoformat(fault_cutoff) > datetime.fromisoformat(train_end) + timedelta(hours=1):
        raise ValueError("the fault cutoff lies beyond the first hour after training")
